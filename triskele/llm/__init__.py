"""Operators of a large-scale training-data pipeline.

Nothing outside this subpackage imports it. ``queries()`` and ``oracle_sql()`` of
``triskele.llm.registry`` hold one query per operator.
"""
