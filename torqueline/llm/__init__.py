"""Operators for large training corpora, each over whole texts and whole tables.

Nothing outside this subpackage imports it.  ``torqueline.llm.entry`` holds the
registered queries and their SQL.
"""
