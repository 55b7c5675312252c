from __future__ import annotations

import pytest
from pyspark.sql import DataFrame

#: Columns whose names the operators use inside; none may disturb them.
CLASHING = "id long, h1 string, n string, found string, row string, bucket string, node string, label string, score string, _text string, spans string, x string"


@pytest.fixture
def documents(spark):
    """(doc_id, text, lang, source, n_chars) from (doc_id, text) or (doc_id, text, source), with clashing extra columns."""
    def build(rows) -> DataFrame:
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 1, *["?"] * 11) for r in rows]
        return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}")

    return build


@pytest.fixture
def live_broadcasts(spark, monkeypatch):
    """How many broadcasts were made, live now, and lived at a time at most."""
    seen, context = {"made": 0, "now": 0, "most": 0}, spark.sparkContext
    make = context.broadcast

    def broadcast(value):
        sent = make(value)
        end = sent.destroy
        seen["made"] += 1
        seen["now"] += 1
        seen["most"] = max(seen["most"], seen["now"])

        def destroy(*args):
            seen["now"] -= 1
            end(*args)

        sent.destroy = destroy
        return sent

    monkeypatch.setattr(context, "broadcast", broadcast)
    return seen
