"""Scoring of a submission, and the check before upload."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import names as N
from ..functions import strict_double
from ..operators import checks, metrics


def evaluate(submission: DataFrame, solution: DataFrame) -> DataFrame:
    """Scores per stage; raises for the first failed check of the solution, the submission, or their join."""
    checks.raise_first(checks.validate_solution(solution), checks.solution_examples(solution))
    found = checks.submission_examples(submission, solution)
    checks.raise_first(checks.validate_submission(submission, solution), found)
    predicted = submission.withColumn(N.PREDICTION, strict_double(F.col(N.PREDICTION)))
    truth = solution.withColumn(N.RATING, strict_double(F.col(N.RATING)))
    checks.raise_lost(found)
    return metrics.score_by_stage(predicted, truth)


def upload_check(submission: DataFrame, test: DataFrame, order: str | None = None) -> list[str]:
    """Names of the failed checks, in order; an empty list means the file may be uploaded."""
    report = checks.check_submission(submission, test, order)
    return [r.check for r in report.filter(~F.col("passed")).orderBy("check_no").collect()]
