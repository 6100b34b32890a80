"""Identifier, path, period and layer-name expressions. All are JVM-side Columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Sentinel codes that mean "no estimate" in the ACS variables.
SENTINELS = (-666666666, -999999999, -555555555, -1)

# Anatomical order of the layer groups, and the two swap sets.
LAYER_ORDER = ("patch_embed", "stage1", "stage2", "stage3", "stage4", "final_norm", "head")
EARLY_LAYERS = ("patch_embed", "stage1")
LATE_LAYERS = ("stage3", "stage4", "final_norm")

# Patterns of prediction paths.
PRED_PATH_PATTERN = (
    r"(?:^|/)([a-z]{2})/q([1-4])_(\d{4})/"
    r"epoch(\d+)_valset_([a-z]{2})_(\d{4})_q([1-4])_s2_allbands_(.+)_preds\.csv$"
)
BLOCK_PATTERN = r"^features\.(\d+)\."


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_double(x) -> Column:
    """Tolerant cast: text that is no number, and NaN, become NULL."""
    v = _c(x).try_cast("double")
    return F.when(~F.isnan(v), v)


def sentinel_to_null(x, sentinels=SENTINELS) -> Column:
    v = safe_double(x)
    return F.when(~v.isin(*[float(s) for s in sentinels]), v)


def normalize_id(x, width: int = 11) -> Column:
    """Digits of an id, left-padded to ``width`` and never cut; nothing left gives NULL."""
    text = F.regexp_replace(F.trim(_c(x).cast("string")), r"\.0$", "")
    digits = F.regexp_replace(text, r"[^0-9]", "")
    padded = F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits)
    return F.when(digits != "", padded)


def item_key(x) -> Column:
    """Base name of a path without its extension."""
    return F.regexp_extract(_c(x), r"([^/]+?)(\.[^./]*)?$", 1)


def snake_case(x) -> Column:
    joined = F.regexp_replace(_c(x), r"[^0-9A-Za-z]+", "_")
    return F.lower(F.regexp_replace(joined, r"^_+|_+$", ""))


def composite_id(*parts) -> Column:
    return F.concat(*[_c(p).cast("string") for p in parts])


def quarter_label(quarter, year) -> Column:
    return F.concat(F.lit("Q"), _c(quarter).cast("string"), F.lit(" "), _c(year).cast("string"))


def parse_quarter_label(x) -> tuple[Column, Column]:
    """``Q<n> <yyyy>`` to (quarter, year); NULL where the text has another form."""
    pattern = r"^Q([1-4]) (\d{4})$"
    return (
        F.regexp_extract(_c(x), pattern, 1).try_cast("int"),
        F.regexp_extract(_c(x), pattern, 2).try_cast("int"),
    )


def parse_quarter_token(x) -> tuple[Column, Column]:
    """``<yyyy>Q<n>`` (any case) to (year, quarter)."""
    pattern = r"^(\d{4})[Qq]([1-4])$"
    return (
        F.regexp_extract(_c(x), pattern, 1).try_cast("int"),
        F.regexp_extract(_c(x), pattern, 2).try_cast("int"),
    )


def quarter_bounds(year, quarter) -> tuple[Column, Column]:
    """First and last day of a calendar quarter."""
    first = F.make_date(_c(year), (_c(quarter) - 1) * 3 + 1, F.lit(1))
    return first, F.last_day(F.add_months(first, 2))


def parse_period(x, span: int = 5, earliest: int = 2005) -> dict[str, Column]:
    """``YYYY-YYYY`` of exactly ``span`` years; ``reason`` is NULL when the period is valid."""
    pattern = r"^(\d{4})-(\d{4})$"
    start = F.regexp_extract(_c(x), pattern, 1).try_cast("int")
    end = F.regexp_extract(_c(x), pattern, 2).try_cast("int")
    reason = (
        F.when(start.isNull() | end.isNull(), F.lit("format"))
        .when(end - start != span - 1, F.lit("span"))
        .when(start < earliest, F.lit("too_early"))
    )
    return {"start": start, "end": end, "reason": reason, "vintage": F.when(reason.isNull(), end)}


def layer_group(key, drop_other: bool = False) -> Column:
    """Layer group of a dotted parameter name: block 0 is the patch embedding and blocks
    2s-2 and 2s-1 make up stage s."""
    block = F.regexp_extract(_c(key), BLOCK_PATTERN, 1).try_cast("int")
    stage = F.concat(F.lit("stage"), (F.floor(block / 2) + 1).cast("string"))
    group = (
        F.when(block == 0, F.lit("patch_embed"))
        .when(block.isNotNull(), stage)
        .when(_c(key).startswith("norm."), F.lit("final_norm"))
    )
    return group if drop_other else F.coalesce(group, F.lit("other"))


def directed_pairs(text) -> Column:
    """``ry:rq:dy:dq`` to the two directed pairs it stands for (explode the result)."""
    part = F.split(_c(text), ":")
    a = (part[0].try_cast("int"), part[1].try_cast("int"))
    b = (part[2].try_cast("int"), part[3].try_cast("int"))

    def pair(r, d):
        return F.struct(
            r[0].alias("recipient_year"), r[1].alias("recipient_quarter"),
            d[0].alias("donor_year"), d[1].alias("donor_quarter"),
        )

    return F.array(pair(a, b), pair(b, a))


def parse_pred_path(x) -> dict[str, Column]:
    """Model period, evaluation period, epoch and variable of a prediction file path.

    One regular-expression pass rewrites the path to its fields; the fields are then split off.
    A path of another form gives NULLs.
    """
    fields = F.split(F.regexp_replace(
        _c(x), r"^.*?" + PRED_PATH_PATTERN, "\u0001" + "\u0001".join(f"${i}" for i in range(1, 9))), "\u0001")

    def part(i):
        return F.get(fields, F.lit(i))  # NULL past the end of an unmatched path

    return {
        "state": part(1),
        "model_quarter": part(2).try_cast("int"),
        "model_year": part(3).try_cast("int"),
        "epoch": part(4).try_cast("int"),
        "eval_year": part(6).try_cast("int"),
        "eval_quarter": part(7).try_cast("int"),
        "variable": part(8),
    }


def pred_path(state, model_year, model_quarter, epoch, eval_year, eval_quarter, variable) -> Column:
    """The path that :func:`parse_pred_path` reads back."""
    return F.format_string(
        "/preds/%s/q%d_%d/epoch%d_valset_%s_%d_q%d_s2_allbands_%s_preds.csv",
        _c(state), _c(model_quarter), _c(model_year), _c(epoch), _c(state),
        _c(eval_year), _c(eval_quarter), _c(variable),
    )
