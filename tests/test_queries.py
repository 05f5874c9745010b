import pytest
from oracle import compare

from keyloom import queries as Q

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query_matches_sql(spark, name):
    df = Q.QUERIES[name](spark, SF)
    if name in Q.SQL:
        compare(df, Q.SQL[name], SF)
    else:
        assert df.count() > 0
