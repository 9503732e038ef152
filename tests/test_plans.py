"""Plan-level checks of the properties the design relies on at scale."""

import contextlib
import io

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_day_filter_pushed_to_both_scans(spark):
    p = plan(E.queries()["vocab_today"](spark, SF))
    pushed = [line for line in p.splitlines() if line.startswith("PushedFilters")]
    assert len(pushed) == 2 and all("GreaterThanOrEqual(collected_at" in x and "LessThan(collected_at" in x
                                    for x in pushed)
    assert "content" not in "".join(line for line in p.splitlines() if line.startswith("ReadSchema"))


def test_top_k_limits_before_the_shuffle(spark):
    p = plan(E.queries()["daily_pick"](spark, SF))
    head = p.split("\n\n")[0]
    # the partial per-group limit sits below the exchange
    assert head.index("Exchange") < head.rindex("WindowGroupLimit")


def test_flagship_has_no_python_and_reads_three_columns(spark):
    p = plan(E.queries()["vocab_extract"](spark, SF))
    assert "ArrowEvalPython" not in p and "BatchEvalPython" not in p
    read = [line for line in p.splitlines() if line.startswith("ReadSchema")]
    assert read == ["ReadSchema: struct<doc_id:bigint,text:string,source:string>"]


def test_feed_payloads_parsed_once(spark):
    p = plan(E.queries()["feed_items"](spark, SF))
    head = p.split("\n\n")[0]
    assert "Filter" not in head.split("Generate")[1]  # nothing pushed below the parse projection
