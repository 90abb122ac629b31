"""Query clean-up and routing, name rules, category keys: ordered rule tables evaluated as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import compact, first_match, tokens


def fix_typos(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Literal replacements in the given order."""
    for wrong, right in rules:
        text = F.replace(text, F.lit(wrong), F.lit(right))
    return text


def parse_typo_rules(lines: str) -> list[tuple[str, str]]:
    """``from→to`` per line; blank and incomplete lines are skipped."""
    pairs = (line.split("→", 1) for line in lines.splitlines() if "→" in line)
    return [(a.strip(), b.strip()) for a, b in pairs if a.strip()]


def valid_project_name(name: Column, generic: list[str], fragments: str = "(은|는|을|를|하고|한다|합니다|[.?!])$") -> Column:
    """10 to 150 characters, no generic name, not the end of a sentence."""
    return F.coalesce(F.length(F.trim(name)).between(10, 150) & ~F.lower(F.trim(name)).isin(generic) & ~F.trim(name).rlike(fragments), F.lit(False))


def category_key(value: Column, names: dict[str, str]) -> Column:
    """By the table, then without a ``NN. `` prefix, then by a table key inside the value, else itself."""
    table = F.create_map(*[x for k, v in sorted(names.items()) for x in (F.lit(k), F.lit(v))])
    bare = F.trim(F.regexp_replace(value, "^[0-9]+[. ]+", ""))
    inside = F.element_at(F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in sorted(names.items())]), lambda p: F.contains(value, p["k"])), 1)
    found = F.when(F.exists(F.array(*[F.lit(k) for k in sorted(names)]), lambda k: F.contains(value, k)), inside["v"])
    return F.coalesce(F.try_element_at(table, value), F.try_element_at(table, bare), found, value)


def filename_confidence(name: Column, types: str, kinds: str, technologies: str, domains: str) -> Column:
    """Document type 0.25, a project part 0.25, project kind 0.20, technology 0.15, domain 0.15."""
    hit = lambda pattern, weight: F.when(F.lower(name).rlike(pattern), weight).otherwise(0.0)
    return hit(types, 0.25) + F.when(F.size(F.split(name, "[_ -]")) >= 2, 0.25).otherwise(0.0) + hit(kinds, 0.20) + hit(technologies, 0.15) + hit(domains, 0.15)


def title_match(title: Column, query: str) -> Column:
    """1 if one compact text holds the other, else shared tokens by the larger token count."""
    wanted = F.array_distinct(tokens(F.lit(query)))
    own = F.array_distinct(tokens(title))
    whole = F.contains(compact(title), F.lit("".join(query.lower().split()))) | F.contains(F.lit("".join(query.lower().split())), compact(title))
    return F.when(whole & (F.length(compact(title)) > 0), 1.0).otherwise(F.size(F.array_intersect(own, wanted)) / F.greatest(F.size(own), F.size(wanted), F.lit(1)))


def analyse_prompt(text: Column, organisations: str, kinds: list[tuple[str, list[str]]]) -> Column:
    """Organisation, year, kind and number of search terms of a prompt, as a struct."""
    return F.struct(
        F.nullif(F.regexp_extract(text, organisations, 1), F.lit("")).alias("organisation"),
        F.nullif(F.regexp_extract(text, "(20[0-9]{2})", 1), F.lit("")).alias("year"),
        first_match(text, kinds, "none").alias("kind"),
        F.size(F.array_distinct(tokens(text, 2))).cast("long").alias("terms"),
    )


def search_terms(text: Column, generic: list[str], most: int = 8) -> Column:
    """Distinct terms of two characters or more without generic ones, at most ``most``."""
    return F.slice(F.array_except(F.array_distinct(tokens(text, 2)), F.array(*[F.lit(g) for g in generic])), 1, most)


def scope(catalogue: DataFrame, wanted: list[str] | None, default: str) -> DataFrame:
    """Snapshots to search: the wanted ones that exist, all for ['all'], else the default."""
    if wanted == ["all"]:
        return catalogue
    return catalogue.filter(F.col("snapshot").isin(wanted or [default]))
