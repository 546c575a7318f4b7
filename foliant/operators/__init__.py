"""Operators over documents: match, infer, respond, line items, sources, merge, generate, heal."""
