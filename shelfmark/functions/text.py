"""Text expressions: tokens, match counts, README statistics, renderings."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark import constants as C


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(text: Column | str) -> Column:
    """Remove white space at both ends, Unicode spaces included."""
    return F.regexp_replace(_col(text), f"^{C.WHITESPACE}|{C.WHITESPACE}$", "")


def whitespace_tokens(text: Column | str) -> Column:
    """Tokens between runs of white space; NULL text has none."""
    return F.array_remove(F.split(F.coalesce(_col(text), F.lit("")), C.WHITESPACE), "")


def token_count(text: Column | str) -> Column:
    return F.size(whitespace_tokens(text))


def terms(text: Column | str) -> Column:
    """Analysed terms: lower case, split on everything but letters, digits and '_'."""
    return F.array_remove(F.split(F.lower(F.coalesce(_col(text), F.lit(""))), C.NON_TERM), "")


def clean_string(text: Column | str) -> Column:
    """Stripped text, with empty and 'nan' as NULL."""
    stripped = strip(_col(text).cast("string"))
    return F.when(~stripped.isin("", "nan"), stripped)


def clean_list(items: Column | str) -> Column:
    """A list without NULLs; an empty list is NULL."""
    kept = F.array_compact(_col(items).cast("array<string>"))
    return F.when(F.size(kept) > 0, kept)


def title_case(text: Column | str) -> Column:
    """Upper-case the first letter of every run of letters."""
    runs = F.regexp_extract_all(F.lower(_col(text)), F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(runs, F.initcap), "")


def _json_text_sql(column: str) -> str:
    quoted = """concat('"', replace(replace(item, '\\\\', '\\\\\\\\'), '"', '\\\\"'), '"')"""
    items = f"transform({column}, item -> coalesce({quoted}, 'null'))"
    return f"concat('[', array_join({items}, ', '), ']')"


def json_text(column: str) -> Column:
    """A list of strings as JSON text with ', ' between items; NULL stays NULL."""
    return F.expr(_json_text_sql(column))


def catalog_text() -> Column:
    """All searchable fields of a catalog row in one string, in original case."""
    plain = [f"coalesce({c}, '')" for c in ("title", "description", "readme_text")]
    lists = [f"coalesce({_json_text_sql(c)}, '')" for c in ("tags", "modalities", "languages")]
    return F.expr(f"concat_ws(' ', {', '.join(plain + lists)})")


def search_text() -> Column:
    return F.lower(catalog_text())


def token_hits(text: Column, tokens: list[str]) -> Column:
    """How many of the query tokens occur in the text; repeated tokens count again."""
    hits = F.lit(0)
    for token in tokens:
        hits = hits + F.contains(text, F.lit(token)).cast("int")
    return hits


def tokens_found(text: Column, tokens: list[str]) -> Column:
    """The query tokens that occur in the text, in query order."""
    if not tokens:
        return F.array().cast("array<string>")
    return F.filter(F.array(*[F.lit(t) for t in tokens]), lambda t: F.contains(text, t))


def readme_score_linear(tokens: Column | str) -> Column:
    return F.least(_col(tokens) / F.lit(C.README_SCORE_LINEAR_TOKENS), F.lit(1.0))


def readme_score_log(tokens: Column | str) -> Column:
    full = F.log1p(F.lit(float(C.README_SCORE_LOG_TOKENS)))
    return F.least(F.log1p(_col(tokens).cast("double")) / full, F.lit(1.0))


def readme_stats(text: Column | str) -> Column:
    """Struct of tokens, score, title and description of a README.

    The description is the first plain line. The title is the last heading read
    before the first plain line that is reached with a title already known.
    """
    text = _col(text)
    lines = F.filter(
        F.transform(F.split(F.coalesce(text, F.lit("")), C.LINE_END), strip), lambda line: line != ""
    )
    none = F.lit(None).cast("string")
    start = F.struct(none.alias("title"), none.alias("description"), F.lit(False).alias("done"))

    def read(state: Column, line: Column) -> Column:
        heading = strip(F.regexp_replace(line, "^#+", ""))
        is_heading = line.startswith("#")
        title = F.when(is_heading & ~state.done, F.when(heading != "", heading)).otherwise(state.title)
        first = F.when(~is_heading & ~state.done, F.coalesce(state.description, line))
        return F.struct(
            title.alias("title"),
            F.coalesce(first, state.description).alias("description"),
            (state.done | (~is_heading & state.title.isNotNull())).alias("done"),
        )

    found = F.aggregate(lines, start, read)
    tokens = token_count(text)
    return F.struct(
        tokens.alias("tokens"),
        readme_score_log(tokens).alias("score"),
        found.title.alias("title"),
        found.description.alias("description"),
    )


def modalities_of(tasks: Column | str) -> Column:
    """Modalities of a list of tasks, first seen first; none is NULL."""
    entries = []
    for task, modalities in C.TASK_MODALITIES.items():
        entries += [F.lit(task), F.array(*[F.lit(m) for m in modalities])]
    lookup = F.create_map(*entries)
    lists = F.array_compact(F.transform(_col(tasks), lambda t: F.try_element_at(lookup, t)))
    found = F.array_distinct(F.flatten(lists))
    return F.when(F.size(found) > 0, found)


def size_rank(size_class: Column | str) -> Column:
    """Position among the ordered size classes; unknown and NULL are -1."""
    order = F.array(*[F.lit(s) for s in C.SIZE_CLASSES])
    return F.coalesce(F.array_position(order, _col(size_class)).cast("int") - 1, F.lit(-1))


def fingerprint(*parts: Column | str) -> Column:
    """SHA-256 of the parts joined by '|', NULL as empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(_col(p), F.lit("")) for p in parts]), 256)
