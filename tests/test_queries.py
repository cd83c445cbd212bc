"""Every registered query against its SQL, on the smallest tables."""

import pytest
from checks.compare import differences
from checks.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(fresh, name):
    assert differences(fresh, FOLDER, name) == []
