"""Checked queries: sources, sinks, projections, filters and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import before_last_month, month_index
from ..operators.encoders import MISSING_CODE, apply_codes, split_category_counts
from ..operators.groupstats import fingerprint, frequency_table, attach_long
from ..operators.blend import mean_blend
from ..operators.lookup import append_block, attach, join_identity, members, select_keys
from ..operators.metrics import auc_value
from ..operators.narrow import (
    category_texts, column_counts, drop_constant, drop_empty, narrowing_profile, narrowing_report, select_columns, text_categories,
)
from ..functions.emails import email_provider
from ..operators.sampling import downsample_negatives
from ..schema import KEY, SUBMISSION_SCHEMA, codes_to_int, declare_categorical, drop_label
from ..session import scratch_path, settle
from ..sources.sinks import append_trials, next_trial, read_trials, submission, write_oof, write_submission
from ..sources.tables import head, read_csv, reuse_or_build
from .fixtures import IDENTITY, ident, joined, oof, sql, tx
from .registry import query
from .tools import tidy


@query("a1_csv_scan", sql("select TransactionID, TransactionDT, TransactionAmt, ProductCD, card2, dist1, "
                          "P_emaildomain from tx", "tx"))
def a1(spark, folder):
    rows = tx(spark, folder).select(KEY, "TransactionDT", "TransactionAmt", "ProductCD", "card2", "dist1",
                                    "P_emaildomain")
    path = scratch_path(spark, "csv")
    rows.write.option("header", True).csv(path)
    return read_csv(spark, path, rows.schema)


@query("a2_head", sql("select * from joined order by TransactionID limit 5", "joined"))
def a2(spark, folder):
    return head(joined(spark, folder), 5, KEY)


@query("a3_stage_table", sql("select card1, count(*) as n from tx group by card1", "tx"))
def a3(spark, folder):
    path = scratch_path(spark, "stage")

    def build():
        return tx(spark, folder).groupBy("card1").agg(F.count(F.lit(1)).alias("n"))

    reuse_or_build(spark, path, build)
    return reuse_or_build(spark, path, build)


@query("a4_submission_template", sql("select TransactionID, cast(0.5 as double) as isFraud from tx "
                                     "where split = 'test'", "tx"))
def a4(spark, folder):
    path = scratch_path(spark, "template")
    tx(spark, folder).where("split = 'test'").select(KEY, F.lit(0.5).alias("isFraud")).write.option(
        "header", True).csv(path)
    return read_csv(spark, path, SUBMISSION_SCHEMA)


@query("a5_submission_sink", sql(
    "select TransactionID, round(avg(prediction), 6) as isFraud, (select round((sum(case when label = 1 then r end) "
    "- sum(label) * (sum(label) + 1) / 2) / (sum(label) * sum(1 - label)), 5) from (select label, rank() over "
    "(order by p) + (count(*) over (partition by p) - 1) / 2.0 as r from (select TransactionID, label, "
    "round(avg(prediction), 9) as p from oof group by all))) as score from oof group by TransactionID", "oof"))
def a5(spark, folder):
    rows = settle(oof(spark, folder))
    labels = rows.select(KEY, "label").distinct()
    blend = settle(mean_blend(rows))
    score = auc_value(blend.join(labels, KEY).withColumn("prediction", F.round("prediction", 9)))
    path = write_submission(submission(rows.select(KEY).distinct(), blend), scratch_path(spark, "out"), score)
    written = float(path.rsplit("_", 1)[1].removesuffix(".csv"))
    return tidy(read_csv(spark, path, SUBMISSION_SCHEMA).withColumn("score", F.lit(written)))


@query("a6_oof_sink", sql("select model, fold, TransactionID, label, round(prediction, 6) as prediction from oof",
                          "oof"))
def a6(spark, folder):
    rows = oof(spark, folder)
    path = scratch_path(spark, "oof")
    write_oof(rows, path)
    return tidy(spark.read.schema(rows.schema).parquet(path))


@query("a7_trial_history", sql(
    "select 'amounts' as study, row_number() over (order by ProductCD) - 1 as trial, round(max(TransactionAmt), 6) "
    "as top, round(avg(TransactionAmt), 6) as score, (select count(distinct ProductCD) from tx) as next_trial "
    "from tx group by ProductCD", "tx"))
def a7(spark, folder):
    path = scratch_path(spark, "trials")
    scored = tx(spark, folder).groupBy("ProductCD").agg(
        F.max("TransactionAmt").alias("top"), F.avg("TransactionAmt").alias("score")).orderBy("ProductCD").collect()
    for r in scored:
        at = next_trial(read_trials(spark, path, "amounts"))
        append_trials(spark, path, [("amounts", at, {"top": r["top"]}, r["score"])])
    history = read_trials(spark, path, "amounts")
    return tidy(history.select("study", "trial", F.col("params")["top"].alias("top"), "score",
                               F.lit(next_trial(history)).alias("next_trial")))


@query("a8_append_block", sql(
    "select tx.TransactionID, TransactionAmt, coalesce(b.b1, -1) as b1, case when b.b2 = 'inf' then -1 else "
    "coalesce(b.b2, -1) end as b2 from tx left join (select TransactionID, id_02 as b1, case when id_20 = 0 then "
    "cast('inf' as double) else id_20 * 0.5 end as b2 from ident) b using (TransactionID)", "tx", "ident"))
def a8(spark, folder):
    block = ident(spark, folder).select(KEY, F.col("id_02").alias("b1"), F.expr(
        "case when id_20 = 0 then double('inf') else id_20 * 0.5d end").alias("b2"))
    return append_block(tx(spark, folder).select(KEY, "TransactionAmt"), block)


_DECLARED = ["card1", "card2", "card3", "card4", "card5", "card6", "addr1", "addr2", "id_20", "id_30", "id_31", "id_33",
             "id_35"]


@query("b1_declared_categories", sql(" union all ".join(
    f"select '{c}' as \"column\", count(*) filter ({c} is null) as nulls, count(distinct {c}) as categories "
    f"from joined" for c in _DECLARED), "joined"))
def b1(spark, folder):
    rows = joined(spark, folder)
    roles = declare_categorical(rows)
    declared = [c for c in roles.categorical if c in _DECLARED]
    return column_counts(rows, declared).select("column", "nulls", F.col("distincts_not_null").alias("categories"))


_NARROWED = [("TransactionDT", "bigint"), ("TransactionAmt", "double"), ("card1", "bigint"), ("card2", "bigint"),
             ("card3", "bigint"), ("dist1", "double"), ("C1", "bigint"), ("D8", "double"), ("D15", "bigint")]
_TRIED = [("tinyint", "tinyint"), ("smallint", "smallint"), ("int", "integer"), ("float", "float")]


def _narrow_sql() -> str:
    parts = []
    for c, kind in _NARROWED:
        stats = [f"'{c}' as col", f"'{kind}' as from_type", f"count(*) filter ({c} is null) as nulls",
                 f"count(distinct {c}) + max(case when {c} is null then 1 else 0 end) as distincts"]
        for name, duck in _TRIED:
            value = f"round({c})" if kind == "double" and name != "float" else c
            t = f"try_cast({value} as {duck})"
            stats.append(f"coalesce(max(abs(cast({t} as double) - {c})), 0) <= 0.001 and count(*) filter ({t} is "
                         f"null) = count(*) filter ({c} is null) and count(distinct {t}) = count(distinct {c}) "
                         f"as ok_{name}")
        parts.append(f"select {', '.join(stats)} from tx")
    whole = " ".join(f"when nulls = 0 and ok_{n} then '{n}'" for n, _ in _TRIED)
    return f"select col as \"column\", from_type, case {whole} when ok_float then 'float' else from_type end as " \
           f"to_type, nulls, distincts from ({' union all '.join(parts)})"


@query("b2_narrowing", sql(_narrow_sql(), "tx"))
def b2(spark, folder):
    return narrowing_profile(tx(spark, folder), [c for c, _ in _NARROWED])


@query("b3_narrowing_report", sql(
    "+ size as (select * from (values ('tinyint', 1), ('smallint', 2), ('int', 4), ('bigint', 8), ('float', 4), "
    f"('double', 8)) s(kind, bytes)), prof as ({_narrow_sql()}) select prof.*, cast(a.bytes as bigint) as "
    "bytes_before, cast(b.bytes as bigint) as bytes_after, nulls as nulls_after, distincts as distincts_after, "
    "false as lost_nulls, false as lost_values from prof join size a on a.kind = from_type join size b on "
    "b.kind = to_type", "tx"))
def b3(spark, folder):
    return tidy(narrowing_report(tx(spark, folder), [c for c, _ in _NARROWED]))


_TEXTS = ["ProductCD", "card4", "card6", "P_emaildomain", "R_emaildomain"]


@query("b3_text_categories", sql("select TransactionID, " + ", ".join(
    f"case when {c} is not null then dense_rank() over (order by {c} nulls last) - 1 end as {c}, {c} as {c}_text" for c in _TEXTS)
    + ", 'tinyint' as kinds from tx", "tx"))
def b3_texts(spark, folder):
    """Texts as narrow codes, next to the texts that the dictionary gives back."""
    coded, words = text_categories(tx(spark, folder).select(KEY, *_TEXTS))
    kinds = F.lit(",".join(sorted({kind for c, kind in coded.dtypes if c != KEY})))
    return tidy(category_texts(coded, words, _TEXTS).withColumn("kinds", kinds))


@query("b4_selector", sql("select TransactionID, card1, D15 from tx", "tx"))
def b4(spark, folder):
    return select_columns(tx(spark, folder), [KEY, "card1", "D15"])


@query("b5_drop_constant", sql("select TransactionID, card3, C1 from tx", "tx"))
def b5(spark, folder):
    return drop_constant(tx(spark, folder).select(KEY, "card3", "addr2", "C1"))


@query("b6_label_split", sql("select tx.* exclude (isFraud, TransactionDT), isFraud as label from tx", "tx"))
def b6(spark, folder):
    features, labels = drop_label(tx(spark, folder), "TransactionDT")
    return features.join(labels.withColumnRenamed("isFraud", "label"), KEY)


@query("b9_category_codes", sql("select TransactionID, id_20, try_cast(id_33 as bigint) as id_33 from ident", "ident"))
def b9(spark, folder):
    text = ident(spark, folder).select(KEY, F.col("id_20").cast("string").alias("id_20"), "id_33")
    return tidy(codes_to_int(text, ["id_20", "id_33"]))


_MONTH_START = "2017-11-15 00:00:00"
_MONTH_SQL = "(year(date '2017-11-15' + cast(floor(TransactionDT / 86400) as integer)) - 2017) * 12 + " \
             "month(date '2017-11-15' + cast(floor(TransactionDT / 86400) as integer))"


@query("b10_before_last_month", sql(
    f"+ m as (select TransactionID, {_MONTH_SQL} as month from tx) select * from m where month < (select max(month) "
    "from m)", "tx"))
def b10(spark, folder):
    rows = tx(spark, folder).select(KEY, month_index("TransactionDT", _MONTH_START).alias("month"))
    return tidy(before_last_month(rows, F.col("month")))




@query("b11_membership", sql(
    "+ t as (select distinct card5 as v from tx where isFraud = 1 and card5 is not null) select TransactionID, "
    "card5, 'in' as part from tx where card5 in (select v from t) union all select TransactionID, card5, 'out' from "
    "tx where card5 is null or card5 not in (select v from t)", "tx"))
def b11(spark, folder):
    rows = tx(spark, folder).select(KEY, "card5", "isFraud")
    allowed = rows.where("isFraud = 1 and card5 is not null").select("card5").distinct()
    inside = members(rows, "card5", allowed).select(KEY, "card5", F.lit("in").alias("part"))
    return inside.unionByName(members(rows, "card5", allowed, negate=True).select(
        KEY, "card5", F.lit("out").alias("part")))


@query("b12_drop_empty_identity", sql(
    f"select TransactionID, id_01, id_31 from joined where coalesce({', '.join(f'cast({c} as varchar)' for c in IDENTITY)}) "
    "is not null", "joined"))
def b12(spark, folder):
    return drop_empty(joined(spark, folder).select(KEY, *IDENTITY), IDENTITY).select(KEY, "id_01", "id_31")


@query("b13_fingerprint_filter", sql(
    f"select TransactionID from joined where coalesce({', '.join(f'cast({c} as varchar)' for c in IDENTITY)}) "
    "is not null", "joined"))
def b13(spark, folder):
    return joined(spark, folder).select(KEY, fingerprint(IDENTITY).alias("user_id")).where(
        "user_id is not null").select(KEY)


@query("c1_left_join", sql("select * from joined", "joined"))
def c1(spark, folder):
    return join_identity(tx(spark, folder), ident(spark, folder))


@query("c2_null_safe_lookup", sql(
    "select tx.TransactionID, tx.card2, n as card2_count from tx left join (select card2, count(*) as n from tx "
    "group by card2) c on tx.card2 is not distinct from c.card2", "tx"))
def c2(spark, folder):
    rows = tx(spark, folder).select(KEY, "card2")
    counts = settle(frequency_table(rows, ["card2"]))
    return attach_long(rows, counts, {"card2": {"card2_count": "n"}})


@query("c3_category_counts_join", sql(
    "select a.card5, train_n, test_n from (select card5, count(*) as train_n from tx where split = 'train' and card5 "
    "is not null group by card5) a join (select card5, count(*) as test_n from tx where split = 'test' group by card5) "
    "b using (card5)", "tx"))
def c3(spark, folder):
    return split_category_counts(tx(spark, folder), "card5")


@query("c4_stats_join_back", sql(
    "select TransactionID, case when id_31 is not null then avg(TransactionAmt) over (partition by id_31) end as m "
    "from joined".replace("case when", "round(case when").replace(" end as m", " end, 6) as m"), "joined"))
def c4(spark, folder):
    rows = joined(spark, folder).select(KEY, "id_31", "TransactionAmt")
    stats = rows.where("id_31 is not null").groupBy("id_31").agg(F.avg("TransactionAmt").alias("m"))
    inner = attach(rows, stats, {"id_31": "id_31"}, how="inner").select(KEY, "m")
    return tidy(rows.select(KEY).join(inner, KEY, "left"))


@query("c5_dictionary_lookup", sql(
    "select TransactionID, case when P_emaildomain in ('gmail', 'gmail.com') then 'google' when P_emaildomain in "
    "('yahoo.com.mx') then 'yahoo' when P_emaildomain in ('protonmail.com', 'comcast.net', 'scranton.edu') then "
    "'other' when P_emaildomain = 'hotmail.co.uk' then 'microsoft' end as provider from tx", "tx"))
def c5(spark, folder):
    return tx(spark, folder).select(KEY, email_provider("P_emaildomain").alias("provider"))


@query("c6_keyed_assignment", sql(
    "select TransactionID, TransactionAmt, id_01 as assigned from joined", "joined"))
def c6(spark, folder):
    return attach(tx(spark, folder).select(KEY, "TransactionAmt"),
                  ident(spark, folder).select(KEY, F.col("id_01").alias("assigned")), {KEY: KEY})


@query("c7_rows_of_sample", sql(
    "+ ranked as (select TransactionID, isFraud, row_number() over (partition by isFraud order by "
    "(TransactionID % 10007 * 7919) % 10007, TransactionID) as rn, count(*) over (partition by isFraud) as n from tx) "
    "select TransactionID, card1, D15 from tx where TransactionID in (select TransactionID from ranked where isFraud = "
    "1 or rn <= round_even(0.2 * n, 0))", "tx"))
def c7(spark, folder):
    rows = tx(spark, folder)
    sample = downsample_negatives(rows.select(KEY, "isFraud"), 0.2, portable=True)
    return select_keys(rows.select(KEY, "card1", "D15"), sample)


@query("c8_encoder_lookup", sql(
    "+ codes as (select ProductCD, row_number() over (order by ProductCD) as code from (select distinct ProductCD from "
    "tx where split = 'train' and isFraud = 0)) select TransactionID, coalesce(code, -999) as ProductCD from tx left "
    "join codes using (ProductCD)", "tx"))
def c8(spark, folder):
    from ..operators.encoders import label_codes
    rows = tx(spark, folder)
    table = label_codes(rows.where("split = 'train' and isFraud = 0"), ["ProductCD"])
    shifted = settle(table.withColumn("code", F.col("code") + 1))
    return apply_codes(rows.select(KEY, "ProductCD"), shifted, ["ProductCD"], MISSING_CODE)
