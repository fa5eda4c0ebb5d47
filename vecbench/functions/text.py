"""Text columns: prompt resolution (P13), bibtex citation (P15), lookups with
defaults (P18, P19) and language / script parts of codes (P8, P10)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def literal_map(d: Mapping[str, str]) -> Column:
    """A small, bounded driver-side dictionary as a map literal."""
    if not d:
        return F.create_map().cast("map<string,string>")
    items = []
    for k, v in d.items():
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)


def lookup(col: str | Column, table: Mapping[str, str], default: str | None = None) -> Column:
    """``replace_strict(table, default)`` as ``coalesce(map[col], default)``."""
    found = F.element_at(literal_map(table), _c(col))
    return found if default is None else F.coalesce(found, F.lit(default))


def fold_values(col: str | Column, members: list[str], into: str) -> Column:
    """Every value in ``members`` becomes ``into`` (e.g. programming languages -> code)."""
    c = _c(col)
    return F.when(c.isin(members), F.lit(into)).otherwise(c)


def resolve_prompt(prompts: Mapping[str, str], task_name: str | Column, task_type: str | Column,
                   prompt_type: str | Column) -> Column:
    """The prompt for a (task, prompt type), most specific key first.

    Keys tried in order: ``<task>-<prompt type>``, ``<task>``,
    ``<task type>-<prompt type>``, ``<task type>``, ``<prompt type>``.
    NULL when none is defined. (The documented contract names the key forms
    but no precedence; most specific first is this library's rule.)
    """
    m = literal_map(prompts)
    tn, tt, pt = (F.lit(x) if isinstance(x, str) else x for x in (task_name, task_type, prompt_type))
    keys = [F.concat(tn, F.lit("-"), pt), tn, F.concat(tt, F.lit("-"), pt), tt, pt]
    return F.coalesce(*[F.element_at(m, k) for k in keys])


def with_prompt(text: str | Column, prompt: Column) -> Column:
    """Prefix ``text`` with ``prompt`` when there is one."""
    t = _c(text)
    return F.when(prompt.isNull(), t).otherwise(F.concat(prompt, t))


def bibtex_citation(bib: str | Column) -> Column:
    """`` (First author[ et al.], Year)`` from a bibtex entry.

    Authors come from ``author = {...}``; the list is split on `` and ``, the
    first author on ``, ``: the surname gets `` et al.`` exactly when the first
    author has a comma part. Newlines become spaces. Empty when the entry,
    the author or the year is missing.
    """
    b = _c(bib)
    auth_re = r"author\s*=\s*\{([^}]*)\}"
    year_re = r"year\s*=\s*\{([^}]*)\}"
    authors = F.regexp_extract(b, auth_re, 1)
    first = F.element_at(F.split(authors, " and "), 1)
    first_parts = F.split(first, ", ")
    name = F.when(F.size(first_parts) > 1, F.concat(F.element_at(first_parts, 1), F.lit(" et al.")))\
            .otherwise(F.element_at(first_parts, 1))
    name = F.regexp_replace(name, "\n", " ")
    year = F.regexp_extract(b, year_re, 1)
    ok = b.isNotNull() & b.rlike(auth_re) & b.rlike(year_re)
    return F.when(ok, F.concat(F.lit(" ("), name, F.lit(", "), year, F.lit(")"))).otherwise(F.lit(""))


def lang_part(code: str | Column) -> Column:
    """``eng-Latn`` -> ``eng`` (P8 language match)."""
    return F.split(_c(code), "-").getItem(0)


def script_part(code: str | Column) -> Column:
    """``eng-Latn`` -> ``Latn`` (P8 script match)."""
    return F.element_at(F.split(_c(code), "-"), -1)
