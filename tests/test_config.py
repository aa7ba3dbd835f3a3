import copy
import json

import pytest

from quern.operators import metrics
from quern.sources import config

GOOD = {
    "country": "Kazakhstan", "language": "ru", "currency": "KZT",
    "generation": {
        "periods": [{"label": "recent", "start": 2023, "end": 2026, "weight": 3}, {"label": "early", "start": 2018, "end": 2022, "weight": 1}],
        "categories": [{"code": "1000", "weight": 1}, {"code": "2000", "weight": 1, "enabled": False, "reason": "no source"}],
    },
    "sources": {"hosts": {"law.example": [r"/doc/\d+"]}, "limits": {"max_documents": 10}},
}


def changed(path, value):
    out = copy.deepcopy(GOOD)
    at = out
    for k in path[:-1]:
        at = at[k]
    at[path[-1]] = value
    return out


@pytest.mark.parametrize(
    "path,value,word",
    [(("country",), " ", "country"), (("generation", "periods", 1, "label"), "recent", "twice"), (("generation", "periods", 1, "end"), 2023, "overlap"), (("generation", "periods", 0, "end"), 2000, "ends before"),
     (("generation", "categories", 0, "enabled"), False, "no category"), (("generation", "categories", 1, "reason"), "", "reason"), (("generation", "periods", 0, "weight"), 0, "weight"),
     (("sources", "hosts"), {"Law.Example": ["/x"]}, "host"), (("sources", "hosts"), {"law.example": ["("]}, "no pattern"), (("sources", "limits"), {"x": True}, "limit")],
)
def test_each_fault_is_named(path, value, word):
    assert any(word in x for x in config.issues(changed(path, value)))


def test_good_settings(spark, rows, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps(GOOD))
    loaded = config.load(str(tmp_path / "c.json"))
    assert config.issues(loaded) == []
    assert [tuple(r) for r in config.policy_rows(spark, loaded).collect()] == [("law.example", r"/doc/\d+")]
    got = metrics.with_period(rows("case_year int", (2020,), (2024,), (1990,)), config.periods(spark, loaded)).collect()
    assert [r["year_period_target"] for r in got] == ["early", "recent", None]
    (tmp_path / "bad.json").write_text(json.dumps(changed(("country",), None)))
    with pytest.raises(ValueError, match="country"):
        config.load(str(tmp_path / "bad.json"))
