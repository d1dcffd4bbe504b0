"""Operators for preparing language-model training text, one module each.

Nothing else in the library imports this subpackage. Every operator reads only the columns that
it names, so extra columns, clashing names included, are ignored; those that give rows back give all of their columns.
"""
