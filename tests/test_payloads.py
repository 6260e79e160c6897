import json

import pytest

from tidemark import queries
from tidemark.sources import bars as b


@pytest.mark.parametrize("name, key", [("parse_funding", "fundingTime"), ("parse_open_interest", "timestamp")])
def test_a_payload_holds_one_hour_at_most(spark, sf_dir, monkeypatch, name, key):
    parse, seen = getattr(b, name), []
    monkeypatch.setattr(b, name, lambda raw: seen.append(raw) or parse(raw))
    out = getattr(queries, name)(spark, sf_dir)
    assert out.count() == b.settlements(spark, sf_dir).count()
    for r in seen[0].collect():
        assert len({int(x[key]) // 3_600_000 for x in json.loads(r["payload"])}) == 1
