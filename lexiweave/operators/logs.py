"""Job logs: counters out of free text, and what state a job is in."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The lines that a job writes.
_START = r"\[Round 1\] Initial generation: compliant=(\d+)/(\d+) noncompliant=(\d+)"
_REPAIR = r"\[Round 1\] After deterministic repair: remaining noncompliant=(\d+)"
_RETRY = r"\[Round 1\] After sampled retries: compliant=(\d+)/(\d+) \((\d+\.\d+)%\), sampled_retries_used=(\d+)"


def _number(text: Column, pattern: str, group: int) -> Column:
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group).try_cast("double"))


def statistics(logs: DataFrame) -> DataFrame:
    """Every column of logs but text, its counters (null where a line is missing), and the three rates in percent, rounded half to even."""
    t = F.col("text")
    named = {
        "initial_compliant": (_START, 1), "initial_total": (_START, 2), "initial_noncompliant": (_START, 3), "repair_remaining": (_REPAIR, 1),
        "final_compliant": (_RETRY, 1), "final_total": (_RETRY, 2), "final_percentage": (_RETRY, 3), "retries_used": (_RETRY, 4),
    }
    df = logs.withColumns({k: _number(t, p, g) for k, (p, g) in named.items()}).drop("text")
    rate = lambda a, b: F.bround(F.try_divide(a, b) * 100, 1)
    c = F.col
    return df.withColumns({
        "initial_rate": rate(c("initial_compliant"), c("initial_total")), "repair_rate": rate(c("initial_noncompliant") - c("repair_remaining"), c("initial_noncompliant")),
        "retry_rate": rate(c("repair_remaining") - (c("final_total") - c("final_compliant")), c("repair_remaining")),
    })


def status(logs: DataFrame) -> DataFrame:
    """Every column of logs but text, and status (Completed, Failed, Running), the last round and the percent done."""
    t = F.col("text")
    done = t.contains("SLURM job completed at:") | t.contains("Wrote final pools summary:")
    failed = t.contains("Traceback (most recent call last):")
    rounds, parts = F.regexp_extract_all(t, F.lit(r"\[Round (\d+)\]"), F.lit(1)), F.regexp_extract_all(t, F.lit(r"(\d+)%"), F.lit(1))
    last = lambda a: F.get(a, F.size(a) - 1).try_cast("int")
    state = F.when(done, "Completed").when(failed, "Failed").otherwise("Running")
    return logs.withColumns({"status": state, "last_round": F.when(~done & ~failed, last(rounds)), "percent": F.when(done, 100).when(failed, 0).otherwise(F.coalesce(last(parts), F.lit(0)))}).drop("text")
