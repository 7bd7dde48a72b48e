"""Plan checks: the physical plans hold the properties the scale design relies on."""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.01"
TOP_K = ["top_days", "insights_top", "insights_bottom", "insights_tag_and_category",
         "deep_conversations", "tag_counts", "topic_distribution", "random_insight"]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(E.QUERIES))
def test_no_cartesian_or_nested_loop(spark, key):
    plan = _plan(E.queries()[key](spark, SF))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("key", TOP_K)
def test_top_k_is_a_per_task_heap(spark, key):
    assert "TakeOrderedAndProject" in _plan(E.queries()[key](spark, SF))


def _scans(plan: str) -> list[str]:
    return [ln for ln in plan.split("\n") if "FileScan parquet" in ln]


@pytest.mark.parametrize("key", ["daily_stats", "usage_summary"])
def test_daily_figures_read_text_only_without_a_count(spark, key):
    """The scan of counted messages has no text; the other one is filtered to rows without a count."""
    scans = [s for s in _scans(_plan(E.queries()[key](spark, SF))) if "token_count" in s]
    plain = [s for s in scans if "content" not in s]
    with_text = [s for s in scans if "content" in s]
    assert len(plain) == 1 and len(with_text) == 1
    assert "EqualTo(token_count,0)" in with_text[0] and "IsNull(token_count)" in with_text[0]
    assert not any("char_start" in s or "system_prompt" in s for s in scans)


def test_message_counts_read_no_text(spark):
    assert not any("content" in s for s in _scans(_plan(E.queries()["histogram_week"](spark, SF))))


@pytest.mark.parametrize("key", ["extract_requests", "extract_requests_cut", "summary_requests"])
def test_requests_need_no_window_over_text(spark, key):
    plan = _plan(E.queries()[key](spark, SF))
    assert len(_scans(plan)) <= 4
    assert not any("content" in ln for ln in plan.split("\n") if "Window " in ln)


def test_date_filter_reaches_the_scan(spark):
    plan = _plan(E.queries()["messages_by_date"](spark, SF))
    scans = [ln for ln in plan.split("\n") if "FileScan parquet" in ln and "date" in ln]
    assert any("(date" in ln and "2024-01-05" in ln for ln in scans)


def test_partial_aggregation_before_shuffle(spark):
    plan = _plan(E.queries()["daily_stats"](spark, SF))
    assert "partial_count" in plan or "partial_sum" in plan


def test_preview_limits_before_shuffle(spark):
    plan = _plan(E.queries()["conversation_preview"](spark, SF))
    assert "WindowGroupLimit" in plan and "Partial" in plan
