"""Operators for preparing large training corpora (numbered op1 .. op10) and their queries."""
