"""Printed forms made from fields by expressions that Spark and DuckDB read alike, so that reading them back has an oracle."""

from __future__ import annotations

FAMILIES = "Alder Birch Cedar Dorn Elmer Fenn Grove Hazel Ivers Juniper Kelpen Linden Møller Núñez Oakes".split()
GIVEN = "Ada Ben Cleo Dana Egon Fay Gus Hanna Ira Jon Kim".split()
NOUNS = "kelp moss tides sleep memory reading trust prices soil birds winter".split()
ADJECTIVES = "slow early shared hidden rural daily second".split()


def pick(index: str, values: list[str]) -> str:
    """The value at ``index`` modulo their number."""
    return f"(CASE ({index}) % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END)"


#: Fields of a made reference, by the key ``k``.
FIELDS = {
    "f1": pick("k * 7 + 3", FAMILIES), "f2": pick("k * 11 + 5", FAMILIES), "g1": pick("k * 3", GIVEN), "g2": pick("k * 5 + 1", GIVEN), "year": "(1990 + k % 34)", "volume": "(1 + k * 13 % 97)", "issue": "(1 + k % 6)",
    "first": "(100 + k * 17 % 800)", "last": "(101 + k * 17 % 800 + k % 9)", "title": f"('The ' || {pick('k', ADJECTIVES)} || ' life of ' || {pick('k * 3 + 1', NOUNS)})", "journal": f"('Journal of ' || {pick('k * 5 + 2', NOUNS)})",
}
STYLES = (
    "f1 || ', ' || i1 || '., & ' || f2 || ', ' || i2 || '. (' || year || '). ' || title || '. ' || journal || ', ' || volume || '(' || issue || '), ' || first || '–' || last || '.'",
    "f1 || ' ' || i1 || ', ' || f2 || ' ' || i2 || '. ' || title || '. ' || journal || '. ' || year || ';' || volume || '(' || issue || '):' || first || '-' || last || '.'",
    "f1 || ', ' || g1 || ', and ' || g2 || ' ' || f2 || '. \"' || title || '.\" ' || journal || ' ' || volume || ', no. ' || issue || ' (' || year || '): ' || first || '–' || last || '.'",
    "f1 || ', ' || i1 || '. and ' || f2 || ', ' || i2 || '., ' || year || '. ' || title || '. ' || journal || ', ' || volume || '(' || issue || '), pp.' || first || '-' || last || '.'",
    "i1 || '. ' || f1 || ' and ' || i2 || '. ' || f2 || ', \"' || title || ',\" ' || journal || ', vol. ' || volume || ', no. ' || issue || ', pp. ' || first || '-' || last || ', ' || year || '.'",
    "f1 || ', ' || g1 || ', and ' || g2 || ' ' || f2 || '. \"' || title || '.\" ' || journal || ', vol. ' || volume || ', no. ' || issue || ', ' || year || ', pp. ' || first || '-' || last || '.'",
)
NAME_STYLES = (
    "f1 || ', ' || i1 || '., & ' || f2 || ', ' || i2 || '.'", "f1 || ' ' || i1 || ', ' || f2 || ' ' || i2", "f1 || ', ' || g1 || ', and ' || g2 || ' ' || f2", "g1 || ' ' || f1 || ', ' || g2 || ' van ' || f2",
    "f1 || ', ' || i1 || '.; ' || f2 || ', ' || i2 || '., et al.'", "g1 || ' ' || i2 || '. ' || f1 || ' und ' || g2 || ' ' || f2", "f1 || ', ' || i1 || '., ' || f2 || ', ' || i2 || '., et al.'",
)


def base(table: str, key: str, extra: str = "") -> str:
    """Rows k, i1, i2 and the fields, from a table's key."""
    fields = ", ".join(f"{sql} AS {name}" for name, sql in FIELDS.items())
    return f"(SELECT *, substr(g1, 1, 1) AS i1, substr(g2, 1, 1) AS i2 FROM (SELECT k, {fields}{', ' + extra.split()[-1] if extra else ''} FROM (SELECT {key} AS k{extra} FROM {table}) AS a) AS b)"


def styled(styles: tuple[str, ...]) -> str:
    return f"CASE k % {len(styles)} " + " ".join(f"WHEN {i} THEN {s}" for i, s in enumerate(styles)) + " END"
