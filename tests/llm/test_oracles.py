"""Queries of the training-data operators that SQL can express."""

import pytest

from skein.llm import queries as Q

from .. import oracle


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    oracle.agree(spark, oracle.connect(), Q.queries()[name], Q.oracle_sql()[name])
