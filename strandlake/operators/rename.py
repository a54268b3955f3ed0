"""rename: new ids by number, by a table or by a regular expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import functions as X
from ..model import is_paired, renumber

MODES = ("auto", "generate", "map", "regex")


def resolve_mode(mode: str, mapping, match_regex, replace, generated: bool) -> str:
    """The mode that the arguments ask for; arguments that don't go together are an error."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    has_map, has_regex = mapping is not None, match_regex is not None or replace is not None
    if has_map and has_regex:
        raise ValueError("a mapping can't be combined with a regular expression")
    if mode == "auto":
        mode = "map" if has_map else "regex" if has_regex else "generate"
    elif generated and mode != "generate":
        raise ValueError(f"mode {mode} takes no prefix, start, width or template")
    if mode == "generate" and (has_map or has_regex):
        raise ValueError("mode generate takes neither a mapping nor a regular expression")
    if mode == "map" and (not has_map or has_regex):
        raise ValueError("mode map takes a mapping and nothing else")
    if mode == "regex" and (has_map or match_regex is None or replace is None):
        raise ValueError("mode regex takes match_regex and replace")
    return mode


def rename(
    df: DataFrame,
    mode: str = "auto",
    prefix: str = "seq",
    start: int = 1,
    width: int = 6,
    template: str | None = None,
    mapping: DataFrame | dict | None = None,
    match_regex: str | None = None,
    replace: str | None = None,
    keep_pair_suffix: bool = False,
    dense: bool = False,
) -> DataFrame:
    """Records or pairs with new ids; descriptions stay.

    generate numbers rows by their place, from `start` (with `dense` the ordinals are taken to have no
    gaps, and nothing is moved).  map replaces the ids of `mapping` (old_id, new_id; the last of several
    counts) and keeps others.  regex replaces all matches, with $1, ${name} and $$ in the replacement.
    In pairs the first mate's id makes the new one, which both mates get, with /1 and /2 if asked for.
    """
    generated = template is not None or prefix != "seq" or start != 1 or width != 6
    mode = resolve_mode(mode, mapping, match_regex, replace, generated)
    paired = is_paired(df)
    names = df.columns
    old: Column = F.col("id1" if paired else "id")
    if mode == "generate":
        df = df if dense else renumber(df)
        core = X.generated_id(F.col("ord") + start, prefix, width, template)
    elif mode == "map":
        if isinstance(mapping, dict):
            mapping = df.sparkSession.createDataFrame(list(mapping.items()), "old_id string, new_id string")
        order = F.monotonically_increasing_id() if "line_no" not in mapping.columns else F.col("line_no")
        last = mapping.withColumn("_line", order).groupBy(F.col("old_id").alias("_old")).agg(F.max_by("new_id", "_line").alias("_new"))
        df = df.join(last, old == F.col("_old"), "left")
        core = F.coalesce("_new", old)
    else:
        core = F.regexp_replace(old, F.lit(X.jvm_pattern(match_regex)), F.lit(X.jvm_replacement(replace, match_regex)))
    if not paired:
        return df.withColumn("id", core).select(*names)
    ends = ("/1", "/2") if keep_pair_suffix else ("", "")
    return df.withColumn("_core", core).withColumns({f"id{m}": F.concat("_core", F.lit(e)) for m, e in zip("12", ends, strict=True)}).select(*names)
