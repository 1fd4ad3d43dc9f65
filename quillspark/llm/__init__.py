"""Operators for preparing training data at scale.

Nothing outside this subpackage imports it.  Each module holds one operator with a general DataFrame interface;
``queries`` wraps them into the thin ``opN_<name>`` queries and ``oracle`` holds the SQL that some of them can be
compared with.
"""
