"""Relational operators over segments and the overlay of corrections."""
