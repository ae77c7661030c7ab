"""Operators for preparing text corpora for language-model training.

Each module holds one operator with its own general interface; ``queries``
registers one query per operator over the given tables.  Nothing outside
this package imports it (``__spark_entry__`` adds its queries when it is
present).

Shared rules: an operator reads only the columns it is told to read and
returns only the columns it documents, so extra input columns, whatever their
names, neither break it nor pass through.  A null text counts as empty.
Repeated rows each get their own result row.
"""
