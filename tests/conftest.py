from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tradeloom.session import local_session  # noqa: E402
from tradeloom.sources.roles import ROLES, mask_of  # noqa: E402

TESTDATA = os.environ.get("TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf_dir():
    return f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="session")
def make_lines(spark):
    """Trading lines from dicts; a role counts as present when any dict names it."""
    schema = ("dataset_id string, row_id bigint, sku string, units decimal(18,2), revenue decimal(18,4), stock double, cost decimal(18,4), "
              "margin_pct double, margin_value decimal(18,6), retail decimal(18,2), sell_through double, cover_weeks double, category string, "
              "channel string, week string, name string, brand string, buy_qty double, full_price_sales decimal(18,4), role_mask int")
    from decimal import Decimal

    columns = [f.split()[0] for f in schema.split(", ")]
    decimals = {f.split()[0] for f in schema.split(", ") if "decimal" in f}

    def build(rows, roles=None):
        present = roles or {k for r in rows for k in r if k in ROLES}
        out = []
        for i, r in enumerate(rows):
            full = {"dataset_id": "d", "row_id": i, "units": 1, "revenue": 10, **r, "role_mask": mask_of({"sku", "units", "revenue"} | set(present))}
            out.append(tuple(Decimal(str(full[c])) if c in decimals and full.get(c) is not None else
                             (float(full[c]) if c in ("stock", "margin_pct", "sell_through", "cover_weeks", "buy_qty") and full.get(c) is not None else full.get(c))
                             for c in columns))
        return spark.createDataFrame(out, schema)

    return build
