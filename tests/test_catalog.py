"""Every registered query against its SQL; those without SQL must give rows."""

import pytest

from tests import oracle
from weftline.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    if name in catalog.SQL:
        assert oracle.difference(df, db, catalog.SQL[name]) == ""
    else:
        assert df.count() > 0


def test_entry_without_optional_package():
    import subprocess
    import sys

    code = "import sys; sys.modules['weftline.llm'] = None; import __spark_entry__ as e; assert len(e.queries()) > 40 and not any(n.startswith('op') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True)
