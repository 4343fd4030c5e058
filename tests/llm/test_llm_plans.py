"""Plan properties of the training-data operators, checked on every table that they write on their way."""

import contextlib
import io

import pytest

from skewlens.llm import collocations, common, exact_dedup, license_scan, mixture, near_dedup, packing, secrets, topk
from skewlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
MODULES = (collocations, exact_dedup, license_scan, mixture, near_dedup, packing, secrets, topk)


def text_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("simple")
    return out.getvalue()


@pytest.fixture()
def plans(monkeypatch):
    seen = []

    def spy(df, name):
        seen.append(text_of(df))
        return common.written(df, name)

    for module in MODULES:
        if hasattr(module, "cut"):
            monkeypatch.setattr(module, "cut", spy)
    return seen


@pytest.mark.parametrize("name", ["op4_secrets", "op9_licenses"])
def test_native_operators_run_no_python(spark, plans, name):
    plans.append(text_of(QUERIES[name](spark, SF)))
    assert len(plans) >= 3
    for text in plans:
        assert not any(word in text for word in ("Python", "Arrow", "Pandas")), text


@pytest.mark.parametrize("name", ["op2_mixture", "op3_topk", "op4_secrets", "op6_exact_dedup", "op8_near_dedup", "op9_licenses", "op12_packing",
                                  "op13_collocations"])
def test_no_operator_crosses_rows(spark, plans, name):
    plans.append(text_of(QUERIES[name](spark, SF)))
    for text in plans:
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, text


def test_rows_do_not_shuffle_by_filter_slot(spark, plans):
    QUERIES["op6_exact_dedup"](spark, SF)
    bloom = [text for text in plans if "MapInArrow" in text]
    assert len(bloom) == 1 and "hashpartitioning(part" in bloom[0]
    assert all("slot" not in line for line in bloom[0].splitlines() if "Exchange" in line)
