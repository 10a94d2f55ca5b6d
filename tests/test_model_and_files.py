import csv
import random
import time
from dataclasses import replace
from importlib import import_module
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from catalog import workflows
from catalog.fixtures import Fixtures
from ratewright import names as N
from ratewright.operators import boosting, matrix
from ratewright.operators.metrics import prediction_stats
from ratewright.operators.temporal import split_date
from ratewright.plans import predict, train
from ratewright.schemas import NULL_TOKENS
from ratewright.session import fresh_path, shared_folder, stored
from ratewright.sources import append_embeddings, load_table, publish, published, read_embeddings, read_features, save_table, scan, scan_raw_folder, versioned, write_features, write_submission

FOLDER = "/root/testdata/sf0.001"
training = import_module("ratewright.plans.train")
SETTINGS = boosting.BoostingSettings(max_rounds=6, patience=2, first_rounds=3, step_size=0.1, max_depth=3)


@pytest.mark.parametrize(
    ("losses", "patience", "expected"),
    [
        ([5, 4, 3], 2, (3, False)),
        ([5, 4, 4, 4], 2, (2, True)),
        ([5, 3, 4, 2, 3, 3], 2, (4, True)),
        ([5, 3, 4, 4, 1], 2, (2, True)),
        ([1.0], 1, (1, False)),
    ],
)
def test_best_round(losses, patience, expected):
    assert boosting.best_round(losses, patience) == expected


@pytest.fixture(scope="module")
def prepared(spark):
    return workflows.prepared_features(Fixtures(spark, FOLDER))


def test_training_and_prediction(spark, prepared):
    reports = []
    for _ in range(2):
        path = fresh_path(spark, "model")
        reports.append((train(spark, prepared, path, SETTINGS), predict(spark, prepared, path)))
    (first, predicted), (second, again) = reports
    assert (first.best_round, first.losses) == (second.best_round, pytest.approx(second.losses))
    assert first.best_round == boosting.best_round(first.losses, SETTINGS.patience)[0]
    asked = Fixtures(spark, FOLDER).test
    got = {(r.user_id, r.book_id): r.rating_predict for r in predicted.collect()}
    assert sorted(got) == sorted((r.user_id, r.book_id) for r in asked.collect())
    assert all(0 <= p <= 10 for p in got.values())
    assert got == pytest.approx({(r.user_id, r.book_id): r.rating_predict for r in again.collect()})


def test_trees_are_grown_on_every_early_row(spark, prepared, monkeypatch):
    """More early rows than the former bound of 20,000: the learner gets them all."""
    rows, books = read_features(spark, prepared)
    known = rows.filter(F.col(N.SOURCE) == N.TRAIN)
    times = -(-30_000 // known.count())
    copies = known.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times))))
    folder = fresh_path(spark, "features")
    write_features(copies.withColumn(N.USER, F.col(N.USER) + 10_000_000 * F.col("copy")).drop("copy"), books.drop(N.TFIDF), folder)
    read = read_features(spark, folder)[0]
    early = read.filter(F.col(N.TIMESTAMP) <= F.lit(split_date(read).first().split_date)).count()
    assert early > 20_000

    class Fitted(Exception):
        pass

    def fit(fitted_on, validation, settings):
        raise Fitted(fitted_on.count(), validation.count())

    monkeypatch.setattr(training.boosting, "fit_boosting", fit)
    monkeypatch.setattr(workflows, "prepared_features", lambda x: folder)
    for query in (workflows.gbt_best_round, workflows.gbt_fit_predict):
        with pytest.raises(Fitted) as found:
            query(Fixtures(spark, FOLDER))
        assert found.value.args == (early, read.count() - early)


def test_fixed_order_depends_on_the_rows_alone(spark):
    """Rows that arrive in another order, in other partitions and with ties come out alike."""
    rows = spark.range(5_000).select(
        (F.col("id") % 50).alias(N.USER), (F.col("id") % 7).alias(N.BOOK), (F.col("id") % 11).cast("double").alias(N.RATING)
    )
    layouts = []
    for partitions, seed in ((1, 1), (8, 2), (40, 3)):
        mixed = rows.repartition(partitions, F.rand(seed)).orderBy(F.rand(seed))
        fixed = training.in_fixed_order(training.with_place(mixed), 120_000)
        layouts.append([tuple(r) for r in fixed.withColumn("partition", F.spark_partition_id()).collect()])
    assert layouts[0] == layouts[1] == layouts[2]
    assert len({row[-1] for row in layouts[0]}) == 3


def test_shorter_fit_is_the_start_of_a_longer_one(spark):
    data = stored(
        spark.range(400).select(
            F.array(*[(F.hash("id", F.lit(i)) % 100).cast("double") for i in range(4)]).alias("x"),
            ((F.hash("id") % 7) + (F.hash("id", F.lit(1)) % 100) / 20).cast("double").alias(N.RATING),
        ),
        "boost",
    )
    from pyspark.ml.functions import array_to_vector

    data = data.select(array_to_vector("x").alias(matrix.FEATURES), N.RATING)
    long, short = SETTINGS.regressor(5).fit(data), SETTINGS.regressor(2).fit(data)
    assert [t.toDebugString.split("\n", 1)[1] for t in long.trees[:2]] == [t.toDebugString.split("\n", 1)[1] for t in short.trees]


def test_features_hold_one_line_per_book_and_no_nulls(spark, prepared):
    rows, books = read_features(spark, prepared)
    assert books.count() == rows.select(N.BOOK).distinct().count() == books.select(N.BOOK).distinct().count()
    columns = matrix.feature_columns(rows)
    assert rows.select(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first().asDict() == dict.fromkeys(columns, 0)
    assert N.HAS_READ not in columns and N.TITLE not in columns and N.GENDER in columns
    assert books.filter(F.size(N.EMBEDDING) != workflows.DIM).count() == 0


def test_reading_the_train_half_prunes_partitions(spark, prepared, capsys):
    read_features(spark, prepared)[0].filter(F.col(N.SOURCE) == N.TRAIN).select(N.BOOK).explain()
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(source" in plan


def test_unprepared_features_are_an_error(spark):
    with pytest.raises(AnalysisException):
        read_features(spark, fresh_path(spark, "nothing"))


def test_artefact_versions_are_never_overwritten(spark):
    path = versioned(fresh_path(spark, "artefacts"), "vocabulary", "7")
    save_table(spark.range(3), path)
    with pytest.raises(AnalysisException):
        save_table(spark.range(4), path)
    assert load_table(spark, path).count() == 3


def test_unseen_category_gets_its_own_number(spark):
    rows = spark.createDataFrame([("b",), ("a",), ("c",), (None,), ("a",)], "gender STRING")
    levels = matrix.category_levels(rows)
    asked = spark.createDataFrame([(i, 1, g) for i, g in enumerate(["a", "c", "zz", None])], "user_id INT, book_id INT, gender STRING")
    for heavy in ({}, {"gender": [("a", 3), (None, 2)]}):
        found = matrix.index_categories(asked, levels, heavy).orderBy("user_id").collect()
        assert [r.gender_index for r in found] == [0.0, 2.0, 3.0, 3.0]


def test_a_million_levels_are_numbered_in_order(spark):
    n = 1_000_000
    rows = spark.range(2 * n).select(
        F.format_string("p%07d", F.pmod(F.col("id") * 7_919, F.lit(n))).alias(N.PUBLISHER), (F.col("id") % 2).cast("string").alias(N.GENDER)
    )
    levels = matrix.category_levels(rows)
    expected = F.substring("level", 2, 7).cast("bigint")
    publishers = levels.filter(F.col("column") == N.PUBLISHER)
    assert publishers.count() == n and publishers.filter(expected != F.col("number")).count() == 0
    assert sorted((r.level, r.number) for r in levels.filter(F.col("column") == N.GENDER).collect()) == [("0", 0), ("1", 1)]


def test_scan_finds_columns_by_name_and_keeps_quoted_lines(spark, tmp_path):
    path = tmp_path / "books.csv"
    path.write_text(
        'title;book_id;extra;author_id;author_name;publication_year;language;avg_rating;publisher\n'
        '"two\nlines; ""quoted""";7;x;3;A;1999;12;NaN;5\n'
        ';8;x;;;;;4.5;\n'
    )
    first, second = scan(spark, "books", str(path), sep=";").orderBy(N.ROW_ORDER).collect()
    assert (first.title, first.book_id, first.language, first.avg_rating) == ('two\nlines; "quoted"', 7, "12", None)
    assert (second.title, second.book_id, second.author_id, second.avg_rating) == (None, 8, None, 4.5)


def test_scan_reports_missing_columns_and_malformed_numbers(spark, tmp_path):
    path = tmp_path / "test.csv"
    path.write_text("user_id\n1\n")
    with pytest.raises(ValueError, match="lacks columns"):
        scan(spark, "test", str(path))
    path = tmp_path / "users.csv"
    path.write_text("user_id,gender,age\n1,2,old\n")
    with pytest.raises(Exception, match="column age, .*users.csv, block 0, row 0: not double: old"):
        scan(spark, "users", str(path)).collect()
    path.write_text("user_id,gender,age\n7x,2,1\n")
    with pytest.raises(Exception, match="column user_id.* not int: 7x"):
        scan(spark, "users", str(path)).collect()
    path = tmp_path / "submission.csv"
    path.write_text("user_id,book_id,rating_predict\n1,2,high\n")
    assert scan(spark, "submission", str(path)).first().rating_predict == "high"


def test_null_tokens_are_missing_in_numbers_and_texts(spark, tmp_path):
    path = tmp_path / "users.csv"
    path.write_text("user_id,gender,age\n" + "".join(f'{i},{t},"{t}"\n' for i, t in enumerate(NULL_TOKENS)) + "99,nano,7\n")
    *missing, last = scan(spark, "users", str(path)).orderBy("user_id").collect()
    assert len(missing) == len(NULL_TOKENS) and all(r.gender is None and r.age is None for r in missing)
    assert (last.gender, last.age) == ("nano", 7.0)
    own = scan(spark, "users", str(path), null_tokens={"gender": ["nano", ""], "age": NULL_TOKENS}).orderBy("user_id").collect()
    assert own[-1].gender is None and own[NULL_TOKENS.index("NA")].gender == "NA"


def test_quoted_files_are_cut_at_record_ends(spark, tmp_path):
    """Texts with line breaks, doubled quotes, separators and blank lines, in files of many blocks each."""
    chance = random.Random(4)
    texts = ["".join(chance.choice(['a', 'é', '"', "\n", ",", "\n\n", "\r\n", " ", 'x"y'])for _ in range(chance.randint(1, 90))) for _ in range(1_500)]
    texts = [t if t.strip() and t not in NULL_TOKENS else "plain" for t in texts]
    for k in range(2):
        with open(tmp_path / f"part{k}.csv", "w", newline="") as out:
            writer = csv.writer(out, lineterminator="\r\n" if k else "\n")
            writer.writerow(["book_id", "description"])
            writer.writerows((i, t) for i, t in enumerate(texts) if i % 2 == k)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
        rows = scan(spark, "book_descriptions", str(tmp_path)).orderBy(N.ROW_ORDER).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {r.book_id: r.description for r in rows} == dict(enumerate(texts))
    places = [r.book_id for r in rows]
    assert places == [i for i in range(1_500) if i % 2 == places[0] % 2] + [i for i in range(1_500) if i % 2 != places[0] % 2]


def test_row_order_follows_the_file(spark, tmp_path):
    path = tmp_path / "descriptions.csv"
    path.write_text("book_id,description\n" + "".join(f"{i % 5},text {i}\n" for i in range(500)))
    ordered = scan(spark, "book_descriptions", str(path)).orderBy(N.ROW_ORDER).collect()
    assert [r.description for r in ordered] == [f"text {i}" for i in range(500)]


def test_raw_folder(spark, tmp_path):
    from ratewright.schemas import TABLES

    for table, file in N.FILES.items():
        (tmp_path / file).write_text(",".join(TABLES[table].names) + "\n")
    tables = scan_raw_folder(spark, str(tmp_path))
    assert set(tables) == set(N.FILES) and all(t.count() == 0 for t in tables.values())


def test_submission_as_one_file(spark, tmp_path):
    out = str(tmp_path / "out")
    write_submission(spark.createDataFrame([(1, 2, 7.854)], "user_id INT, book_id INT, rating_predict DOUBLE"), out, single_file=True)
    [part] = (tmp_path / "out").glob("part-*.csv")
    assert part.read_text() == "user_id,book_id,rating_predict\n1,2,7.854\n"


def test_shared_folder_is_the_one_the_session_names(spark):
    assert shared_folder(spark) == shared_folder(spark)
    assert fresh_path(spark, "x").startswith(shared_folder(spark))


def test_a_version_keeps_its_vocabulary_settings(spark):
    build = import_module("ratewright.plans.prepare")
    docs = spark.createDataFrame([(1, "one two", 0), (2, "one", 0)], "book_id INT, description STRING, row_order INT")
    base = fresh_path(spark, "artefacts")
    text = build.TextSettings("v", base, max_features=5, min_df=1, max_df=1.0)
    first = build.fitted_vocabulary(spark, docs, docs, text).count()
    assert build.fitted_vocabulary(spark, docs, docs, text).count() == first
    with pytest.raises(ValueError, match="version v"):
        build.fitted_vocabulary(spark, docs, docs, replace(text, max_features=6))


def test_interrupted_and_doubled_runs_of_a_version(spark):
    build = import_module("ratewright.plans.prepare")
    docs = spark.createDataFrame([(1, "one two", 0), (2, "one", 0)], "book_id INT, description STRING, row_order INT")
    base = fresh_path(spark, "artefacts")
    text = build.TextSettings("v", base, max_features=5, min_df=1, max_df=1.0)
    path = versioned(base, "vocabulary", "v")
    # A run that was lost after its settings, and one that was lost before its mark.
    spark.range(1).write.parquet(f"{path}/run-0/settings")
    publish({"settings": spark.range(1), "vocabulary": spark.range(9)}, path)
    [mark] = Path(path.removeprefix("file:")).glob("run-*/_done")
    mark.unlink()
    assert published(spark, path) is None
    first = sorted(build.fitted_vocabulary(spark, docs, docs, text).collect())
    run = published(spark, path)
    time.sleep(0.05)
    publish({"settings": spark.range(1), "vocabulary": spark.range(9)}, path)
    assert published(spark, path) == run
    assert sorted(build.fitted_vocabulary(spark, docs, docs, text).collect()) == first


def test_a_submission_reports_what_it_wrote(spark):
    rows = spark.createDataFrame([(1, 2, 7.5), (1, 3, 2.5)], "user_id INT, book_id INT, rating_predict DOUBLE").repartition(2)
    stats = write_submission(rows, fresh_path(spark, "submission"))
    assert stats == {"n": 2, "min": 2.5, "max": 7.5, "mean": 5.0} == prediction_stats(rows).first().asDict()


def test_a_book_appended_twice_has_one_embedding(spark):
    path = fresh_path(spark, "embeddings")
    books = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 1.0])], "book_id INT, embedding ARRAY<FLOAT>")
    for _ in range(2):
        append_embeddings(books, path)
    assert sorted(r.book_id for r in read_embeddings(spark, path).collect()) == [1, 2]


def test_artefacts_are_reused_within_a_version_and_only_new_books_encoded(spark):
    build = import_module("ratewright.plans.prepare")
    docs = spark.createDataFrame(
        [(i, f"word{i % 2} common text", 0) for i in range(6)], "book_id INT, description STRING, row_order INT"
    )
    base = fresh_path(spark, "artefacts")

    def settings(version):
        return build.TextSettings(version, base, embedding_dim=4, make_encoder=workflows.hashing_encoder(4), min_df=1, max_df=1.0)

    few, one = docs.filter("book_id < 2"), settings("1")
    assert build.cached_embeddings(spark, few, one).count() == 2
    before = {r.book_id: r.embedding for r in build.cached_embeddings(spark, few, one).collect()}
    after = build.cached_embeddings(spark, docs, one).collect()
    assert sorted(r.book_id for r in after) == list(range(6))
    assert {r.book_id: r.embedding for r in after if r.book_id < 2} == before

    train_rows = docs.select("book_id")
    first = build.fitted_vocabulary(spark, few.filter("book_id = 0"), train_rows, one).collect()
    assert {r.term for r in first} == {"word0", "common", "text", "word0 common", "common text"}
    assert sorted(build.fitted_vocabulary(spark, docs, train_rows, one).collect()) == sorted(first)
    assert build.fitted_vocabulary(spark, docs, train_rows, settings("2")).count() == 7
