"""Checks of submissions and solutions.

Every check reports how many rows fail it, one report line per check, in the order in which a reader should look at them.
The tables to compare are stacked and grouped by their (user, book) pair once. That one aggregation yields repeated,
missing and extra pairs as well as the tallies of bad values, without joins and with partial counts before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import names as N
from ..functions import in_rating_range, malformed_number, strict_double

SUBMISSION_COLUMNS = [N.USER, N.BOOK, N.PREDICTION]
SOLUTION_COLUMNS = [N.USER, N.BOOK, N.RATING, N.STAGE]
EXAMPLES = 5


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("bigint")


def _tally(frame: DataFrame, **flags: Column) -> DataFrame:
    return frame.select(*N.PAIR, *[value.cast("bigint").alias(name) for name, value in flags.items()])


def _per_pair(*tallies: DataFrame) -> DataFrame:
    stacked = tallies[0]
    for tally in tallies[1:]:
        stacked = stacked.unionByName(tally, allowMissingColumns=True)
    flags = [c for c in stacked.columns if c not in N.PAIR]
    return stacked.groupBy(*N.PAIR).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in flags])


def _total(value: Column, name: str) -> Column:
    return F.coalesce(F.sum(value), F.lit(0)).alias(name)


def _repeats(count: Column) -> Column:
    return F.greatest(count - 1, F.lit(0))


def _report(totals: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    lines = [
        F.struct(F.lit(no).alias("check_no"), F.lit(name).alias("check"), failing.cast("bigint").alias("bad_rows"))
        for no, (name, failing) in enumerate(checks, start=1)
    ]
    return totals.select(F.inline(F.array(*lines))).select(
        "check_no", "check", (F.col("bad_rows") == 0).alias("passed"), "bad_rows"
    )


def _missing_columns(frame: DataFrame, needed: list[str]) -> int:
    return len([c for c in needed if c not in frame.columns])


def _column_report(frame: DataFrame, missing: int) -> DataFrame:
    """The report when columns are missing: no later check can run."""
    rows = frame.agg(F.count("*").alias("rows"))
    return _report(rows, [("not_empty", F.col("rows") == 0), ("columns", F.lit(missing))])


def pair_counts(submission: DataFrame, solution: DataFrame) -> DataFrame:
    """Rows of each pair on either side: `(user_id, book_id, n_submission, n_solution)`."""
    one = F.lit(1)
    return _per_pair(_tally(submission, n_submission=one), _tally(solution, n_solution=one))


def pair_diff(submission: DataFrame, solution: DataFrame) -> DataFrame:
    """Pairs on one side only, `kind` being missing (from the submission) or extra."""
    kind = F.when(F.col("n_submission") == 0, F.lit("missing")).when(F.col("n_solution") == 0, F.lit("extra"))
    return pair_counts(submission, solution).select(kind.alias("kind"), *N.PAIR).filter(F.col("kind").isNotNull())


def lost_pairs(submission: DataFrame, solution: DataFrame) -> DataFrame:
    """Solution rows without a prediction, with their stage."""
    return solution.select(N.STAGE, *N.PAIR).join(submission.select(*N.PAIR), N.PAIR, "left_anti")


def examples(frame: DataFrame, keys: list[str], n: int = EXAMPLES) -> DataFrame:
    """The first rows by key, as examples in a report."""
    return frame.orderBy(*keys).limit(n)


def repeated_pairs(frame: DataFrame) -> DataFrame:
    """Pairs that occur more than once and the number of surplus rows."""
    counted = frame.groupBy(*N.PAIR).agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") > 1).select(*N.PAIR, (F.col("n") - 1).alias("surplus"))


def out_of_range(solution: DataFrame) -> DataFrame:
    rating = strict_double(F.col(N.RATING))
    return solution.filter((rating < N.RATING_MIN) | (rating > N.RATING_MAX))


def validate_submission(submission: DataFrame, solution: DataFrame) -> DataFrame:
    """The strict check of a submission against the solution it will be scored with."""
    missing = _missing_columns(submission, SUBMISSION_COLUMNS)
    if missing:
        return _column_report(submission, missing)
    value, one = F.col(N.PREDICTION), F.lit(1)
    malformed = _flag(malformed_number(value))
    pairs = _per_pair(
        _tally(
            submission, n_submission=one, malformed=malformed,
            absent=_flag(strict_double(value).isNull() & ~malformed_number(value)),
        ),
        _tally(solution, n_solution=one),
    )
    given, expected = F.col("n_submission"), F.col("n_solution")
    totals = pairs.agg(
        _total(given, "given"),
        _total(expected, "expected"),
        _total(F.col("malformed"), "malformed"),
        _total(F.col("absent"), "absent"),
        _total(_repeats(given), "repeated"),
        _total(_flag(given == 0), "missing"),
        _total(_flag(expected == 0), "extra"),
    )
    return _report(
        totals,
        [
            ("not_empty", _flag(F.col("given") == 0)),
            ("columns", F.lit(0)),
            ("numeric", F.col("malformed")),
            ("no_nulls", F.col("absent")),
            ("no_duplicates", F.col("repeated")),
            ("row_count", F.abs(F.col("given") - F.col("expected"))),
            ("no_missing_pairs", F.col("missing")),
            ("no_extra_pairs", F.col("extra")),
        ],
    )


def validate_solution(solution: DataFrame) -> DataFrame:
    """The check of a solution table."""
    missing = _missing_columns(solution, SOLUTION_COLUMNS)
    if missing:
        return _column_report(solution, missing)
    value, stage = F.col(N.RATING), F.col(N.STAGE)
    number = strict_double(value)
    pairs = _per_pair(
        _tally(
            solution,
            n=F.lit(1),
            malformed=_flag(malformed_number(value)),
            absent=_flag(number.isNull() & ~malformed_number(value)),
            outside=_flag((number < N.RATING_MIN) | (number > N.RATING_MAX)),
            no_stage=_flag(stage.isNull()),
            other_stage=_flag(~stage.isin(N.PUBLIC, N.PRIVATE)),
            public=_flag(stage == N.PUBLIC),
            private=_flag(stage == N.PRIVATE),
        )
    )
    tallies = ["n", "malformed", "absent", "outside", "no_stage", "other_stage", "public", "private"]
    totals = pairs.agg(*[_total(F.col(c), c) for c in tallies], _total(_repeats(F.col("n")), "repeated"))
    return _report(
        totals,
        [
            ("not_empty", _flag(F.col("n") == 0)),
            ("columns", F.lit(0)),
            ("no_duplicates", F.col("repeated")),
            ("numeric", F.col("malformed")),
            ("no_nulls", F.col("absent")),
            ("in_range", F.col("outside")),
            ("stage_not_null", F.col("no_stage")),
            ("stage_known", F.col("other_stage")),
            ("has_public", _flag(F.col("public") == 0)),
            ("has_private", _flag(F.col("private") == 0)),
        ],
    )


def check_submission(submission: DataFrame, test: DataFrame, order: str | None = None) -> DataFrame:
    """The check before upload: length, missing values, keys, range.

    Keys are compared as a multiset. With `order`, a column that both tables have and that numbers their rows, the pairs
    must also come in the same sequence.
    """
    value, one = strict_double(F.col(N.PREDICTION)), F.lit(1)
    pairs = _per_pair(
        _tally(submission, n_submission=one, absent=_flag(value.isNull()), outside=_flag(~in_rating_range(value))),
        _tally(test, n_test=one),
    )
    given, expected = F.col("n_submission"), F.col("n_test")
    totals = pairs.agg(
        _total(given, "given"),
        _total(expected, "expected"),
        _total(F.col("absent"), "absent"),
        _total(F.col("outside"), "outside"),
        _total(F.abs(given - expected), "unequal"),
    )
    keys = F.col("unequal")
    if order:
        keys = _misplaced(submission, test, order).scalar()
    return _report(
        totals,
        [
            ("length", F.abs(F.col("given") - F.col("expected"))),
            ("no_nulls", F.col("absent")),
            ("keys", keys),
            ("in_range", F.col("outside")),
        ],
    )


def _misplaced(submission: DataFrame, test: DataFrame, order: str) -> DataFrame:
    """One row with the number of places at which the two tables hold different pairs."""
    ours = submission.select(order, F.struct(*N.PAIR).alias("ours"))
    theirs = test.select(order, F.struct(*N.PAIR).alias("theirs"))
    both = ours.join(theirs, order, "full")
    return both.agg(F.count_if(~F.col("ours").eqNullSafe(F.col("theirs"))).alias("misplaced"))


def _first_examples(flagged: DataFrame, n: int) -> DataFrame:
    """From rows (check, stage, user, book, bad): the bad rows of each check and stage, and its first pairs.

    The ranked window keeps `n` rows per group in every partition before the shuffle, so no group meets in one task.
    """
    group = ["check", "stage"]
    totals = flagged.groupBy(*group).agg(F.sum("bad").alias("bad_rows"))
    totals = totals.select("bad_rows", *[F.col(c).alias(f"of_{c}") for c in group])
    first = Window.partitionBy(*group).orderBy(*N.PAIR)
    ranked = flagged.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= n)
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in group]
    return ranked.join(totals, same[0] & same[1]).select(*group, "bad_rows", "place", *N.PAIR)


def _flagged(pairs: DataFrame, checks: list[tuple[str, str | None, Column]]) -> DataFrame:
    entries = [
        F.struct(F.lit(name).alias("check"), F.lit(stage).cast("string").alias("stage"), bad.cast("bigint").alias("bad"))
        for name, stage, bad in checks
    ]
    return pairs.select(*N.PAIR, F.inline(F.array(*entries))).filter(F.col("bad") > 0)


def submission_examples(submission: DataFrame, solution: DataFrame, n: int = EXAMPLES) -> DataFrame:
    """The first pairs that fail each check of a submission, with the number of rows that fail it. Solution rows without a
    prediction (`lost`) are told apart by stage. `(check, stage, bad_rows, place, user_id, book_id)`."""
    one, stage = F.lit(1), F.col(N.STAGE)
    pairs = _per_pair(
        _tally(submission, n_submission=one),
        _tally(solution, n_solution=one, public=_flag(stage == N.PUBLIC), private=_flag(stage == N.PRIVATE)),
    )
    given, expected = F.col("n_submission"), F.col("n_solution")
    checks = [
        ("no_duplicates", None, _repeats(given)),
        ("no_missing_pairs", None, _flag(given == 0)),
        ("no_extra_pairs", None, _flag(expected == 0)),
        *[("lost", name, F.when(given == 0, F.col(name))) for name in (N.PUBLIC, N.PRIVATE)],
    ]
    return _first_examples(_flagged(pairs, checks), n)


def solution_examples(solution: DataFrame, n: int = EXAMPLES) -> DataFrame:
    """The same for the checks of a solution that name pairs: repeated ones and ratings outside the range."""
    number = strict_double(F.col(N.RATING))
    pairs = _per_pair(
        _tally(solution, n=F.lit(1), outside=_flag((number < N.RATING_MIN) | (number > N.RATING_MAX)))
    )
    checks = [("no_duplicates", None, _repeats(F.col("n"))), ("in_range", None, F.col("outside"))]
    return _first_examples(_flagged(pairs, checks), n)


def raise_first(report: DataFrame, found: DataFrame | None = None) -> None:
    """Raise for the first failed check of a report, which has one line per check; with its examples, if `found` has some."""
    failed = report.filter(~F.col("passed")).orderBy("check_no").first()
    if not failed:
        return
    shown = ""
    if found is not None:
        rows = found.filter(F.col("check") == failed.check).orderBy("stage", "place").collect()
        shown = f", for example {[(r[N.USER], r[N.BOOK]) for r in rows]}" if rows else ""
    raise ValueError(f"check '{failed.check}' failed: {failed.bad_rows} bad{shown}")


def raise_lost(found: DataFrame) -> None:
    """Raise if solution rows have no prediction, with the number and the first pairs of each stage."""
    lost = found.filter(F.col("check") == "lost").orderBy("stage", "place").collect()
    if lost:
        totals = {r.stage: r.bad_rows for r in lost}
        shown = {s: [(r[N.USER], r[N.BOOK]) for r in lost if r.stage == s] for s in totals}
        raise ValueError(f"pairs without a prediction: {totals}, for example {shown}")
