"""Operators that prepare training corpora. Nothing else in chatlake imports this subpackage."""
