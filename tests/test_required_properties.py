"""Random fields removed from payloads: quarantine names exactly the removed required ones."""

from hypothesis import given, settings, strategies as st

from skewlens.schemas import STAGE_REQUIRED, TASK_REQUIRED
from skewlens.sources.payloads import read_stages, required_stages
from tests.conftest import stage_json, task_json, write_json

STAGE_DROPPABLE = [f for f in STAGE_REQUIRED if f != "tasks"] + ["firstTaskLaunchedTime", "completionTime"]
TASK_DROPPABLE = TASK_REQUIRED + ["index"]


@settings(max_examples=5, deadline=None, derandomize=True)
@given(docs=st.lists(st.tuples(st.sets(st.sampled_from(STAGE_DROPPABLE), max_size=2),
                               st.lists(st.sets(st.sampled_from(TASK_DROPPABLE), max_size=2), min_size=1, max_size=3)),
                     min_size=1, max_size=4))
def test_quarantine_names_exactly_the_missing_required_fields(spark, docs):
    import tempfile
    root = tempfile.mkdtemp(prefix="skewlens-prop-", dir="/tmp")
    expected = {}
    payload = []
    for i, (stage_drop, task_drops) in enumerate(docs):
        tasks = [task_json(100 * i + j, drop=tuple(d)) for j, d in enumerate(task_drops)]
        doc = stage_json(i, 0, tasks, name=f"s{i}")
        for f in stage_drop:
            doc.pop(f)
        payload.append(doc)
        missing = {f for f in stage_drop if f in STAGE_REQUIRED}
        missing |= {f"tasks.{f}" for d in task_drops for f in d if f in TASK_REQUIRED}
        expected[i] = missing
    write_json(f"{root}/stages/app_id=a/p.json", payload)
    good, bad = required_stages(read_stages(spark, f"{root}/stages", multi_line=True))
    # a document that lost its stageId is reported with stageId NULL (shown as -1)
    got_bad = sorted(((r.stageId if r.stageId is not None else -1), tuple(sorted(r.missing)))
                     for r in bad.select("stageId", "missing").collect())
    want_bad = sorted(((-1 if "stageId" in m else i), tuple(sorted(m))) for i, m in expected.items() if m)
    assert got_bad == want_bad
    assert sorted(r.stageId for r in good.collect()) == sorted(i for i, m in expected.items() if not m)
