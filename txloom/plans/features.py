"""The feature table, from joined transactions to model input."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..functions.dates import date_features
from ..functions.emails import email_features, proton_flags
from ..functions.rows import PAIRS, null_count, pair_features
from ..functions.text import device_features
from ..operators.correlation import pruned_ratios
from ..operators.encoders import apply_codes, label_encode, shared_dictionary
from ..operators.groupstats import COLUMN, COUNT_PER_SPLIT, card_counts, categorical_counts, group_ratios, split_counts, user_stats
from ..operators.impute import fill_constant, impute
from ..schema import ADDRS, CARDS, KEY, LABEL, ROW, SPLIT, TIME, declare_categorical, infer_roles, numeric_columns
from ..session import release, scratch, settle


@dataclass(frozen=True)
class FeatureOptions:
    """``on_null`` / ``on_inf`` are the final fill values.  ``compat`` reproduces the
    original where it differs from what it meant to do."""

    on_null: float = -999.0
    on_inf: float = -999.0
    on_zero: str = "null"
    per_split_counts: bool = True
    prune: bool = True
    threshold: float = 0.99
    method: str = "pairwise"
    mean_fill: bool = False
    compat: bool = False
    pairs: tuple = field(default=tuple(PAIRS))


def row_features(df: DataFrame, options: FeatureOptions = FeatureOptions(), uncounted=()) -> DataFrame:
    """Browser, e-mail, missing-count, date and pair features; none of them moves a row.

    ``uncounted`` columns do not take part in the count of missing values.
    """
    df = df.transform(device_features).transform(proton_flags)
    counted = [c for c in df.columns if c not in (KEY, SPLIT, LABEL, *uncounted)]
    df = df.withColumn("nulls1", null_count(df, counted)).transform(email_features).transform(date_features)
    return pair_features(df, [p for p in options.pairs if p[0] in df.columns and p[1] in df.columns])


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` written, each row with a number of its own: keys may repeat or be missing."""
    return settle(df.withColumn(ROW, F.monotonically_increasing_id()), name, compression="zstd")


def group_features(df: DataFrame, options: FeatureOptions = FeatureOptions()) -> DataFrame:
    """Statistics over groups of rows, computed on a narrow copy of the table.

    Only the columns these features read take part in the shuffles; the wide
    rows travel in blocks of neighbours.  No row is lost or repeated, whatever its key.
    """
    wanted = [KEY, SPLIT, TIME, "TransactionAmt", "D15", *CARDS, *ADDRS,
              *[c for c in df.columns if c.startswith("id_") and c[3:].isdigit()]]
    rows = numbered(df, "numbered")
    slim = rows.select(ROW, *[c for c in dict.fromkeys(wanted) if c in df.columns])
    return rows.transform(lambda d: user_stats(d, counted=slim)).transform(lambda d: card_counts(d, slim)).transform(
        lambda d: group_ratios(d, on_zero=options.on_zero, counted=slim)).drop(ROW)


def prepared_rows(joined: DataFrame, options: FeatureOptions = FeatureOptions()) -> DataFrame:
    """Group and row features, written with a number per row; what was written on the way is deleted."""
    with scratch(joined.sparkSession) as made:
        grouped = group_features(joined, options)
        later = [c for c in grouped.columns if c not in joined.columns and not c.startswith("user_")]
        return made.keep(numbered(row_features(grouped, options, later), "rows"))


def encoded_features(df: DataFrame, options: FeatureOptions = FeatureOptions()) -> DataFrame:
    """All categorical columns as codes of one dictionary, then counts of the codes per split.

    Rows with numbers (``ROW``) lose them at the end and pass no shuffle but in blocks.
    """
    flags = [f.name for f in df.schema.fields if f.dataType.typeName() == "boolean"]
    df = df.withColumns({c: F.col(c).cast("int") for c in flags})
    coded = list(declare_categorical(df.drop(ROW), infer_roles(df.drop(ROW))).categorical)
    dictionary = settle(shared_dictionary(df, coded), "dictionary", COLUMN)
    out = apply_codes(df, dictionary, coded)
    if options.per_split_counts:
        counted = [c for c in COUNT_PER_SPLIT if c in df.columns]
        # The codes of the counted columns alone: the rows need not pass the joins of all columns twice.
        number = [c for c in df.columns if c == ROW]
        slim = apply_codes(df.select(*number, SPLIT, *counted), dictionary, [c for c in counted if c in coded])
        out = split_counts(out, counted, slim)
        out = categorical_counts(out, compat=True, counted=slim) if options.compat and "id_35" in counted else out
    return out.drop(ROW)


def model_input(df: DataFrame, options: FeatureOptions = FeatureOptions()) -> tuple[DataFrame, dict]:
    """Pruned ratios, label codes for what is still text, constant fill; label and key stay aside."""
    dropped = {}
    if options.prune:
        df, dropped = pruned_ratios(df, F.col(SPLIT) == "train", threshold=options.threshold, method=options.method)
    texts = [f.name for f in df.schema.fields if f.dataType.typeName() == "string" and f.name != SPLIT]
    if texts:
        df = label_encode(df, texts)
    numbers = [c for c in numeric_columns(df) if c not in (KEY, LABEL, TIME)]
    if options.mean_fill:
        df = impute(df, numbers, compat=options.compat)
    return fill_constant(df, options.on_null, options.on_inf, numbers).drop(TIME), dropped


def feature_table(joined: DataFrame, options: FeatureOptions = FeatureOptions()) -> DataFrame:
    """Key, split, label and all features.  The group features see the raw rows, as they must:
    counts come before codes, and codes before the counts of codes."""
    with scratch(joined.sparkSession) as made:
        coded = made.keep(settle(encoded_features(prepared_rows(joined, options), options), "coded", compression="zstd"))
    release(joined.sparkSession)
    return model_input(coded, options)[0]


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in numeric_columns(df) if c not in (KEY, LABEL, TIME)]
