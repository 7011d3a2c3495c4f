import pytest

from millrace.plans import feature_queries, relational_queries

from .oracle import compare

QUERIES = {**relational_queries.R.queries, **feature_queries.R.queries}
SQL = {**relational_queries.R.sql, **feature_queries.R.sql}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_the_rows_of_its_sql(spark, sf, name):
    compare(spark, QUERIES[name], SQL[name], sf)


def test_every_query_has_sql_or_is_known_to_lack_it():
    assert set(QUERIES) - set(SQL) == {"a2_explained_variance", "a3_components", "a4_loadings", "a6_forest_accuracy", "a7_refit_accuracy", "g9_importance", "a9_independent_components", "a9_vector_components"}
