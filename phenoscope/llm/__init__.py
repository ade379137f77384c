"""Operators for preparing training corpora.

Nothing outside this subpackage imports it; its queries and their SQL are in
``queries``.
"""
