"""Operators for training-data pipelines; nothing else in the library imports them."""


def queries() -> dict:
    from stillwright.llm.registry import QUERIES

    return dict(QUERIES)


def oracle_sql() -> dict:
    from stillwright.llm.registry import ORACLES

    return dict(ORACLES)
