"""Rule banks as tables: one row per rule, checked and compiled into a ``Bank``.

Columns: ``rule_group`` says what a rule is for, ``rule`` is its name, ``surface`` where its
terms are looked for, ``terms`` a comma list of words or phrases in lower case, or of patterns
in groups of patterns, and ``position`` the order in which results list it. ``guard`` names the
counter that cancels an animal or claim, or the animal that a hide term needs. ``tier`` marks
the rules that the confidence tiers treat apart.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from policyscan.rules.bank import Bank, terms

SCHEMA = (
    "rule_group string, rule string, surface string, terms string, position int, guard string, tier string"
)
#: Rules become expressions of the plan, so a table of any length cannot be one.
MOST_RULES = 5000
#: The surface of each group and the field of the bank that holds it.
GROUPS = {
    "sure_animal": ("title", "sure_animals"),
    "ambiguous_animal": ("title", "ambiguous_animals"),
    "fur_evidence": ("title and tags", "fur_terms"),
    "fur_taxidermy": ("title and tags", "fur_terms"),
    "fur_hide": ("title and tags", "fur_terms"),
    "fur_seal": ("title and tags", "fur_terms"),
    "fur_shown_only": ("title and tags", "fur_terms"),
    "excluded": ("title and tags", "excluded"),
    "tag_negation": ("tags", "tag_negation"),
    "counter": ("title", "counters"),
    "material": ("title and tags", "materials"),
    "byproduct": ("title and tags", "byproducts"),
    "claim": ("title", "claims"),
    "faux_near": ("title", "faux_near"),
    "description": ("description", "descriptions"),
    "override": ("raw tags", "overrides"),
    "candidate": ("title and tags", "candidates"),
    "spelling": ("any", "spellings"),
}
#: Groups whose terms are patterns.
PATTERNS = ("override", "candidate", "spelling")
#: Groups that the plan asks for by the names of their rules.
KNOWN = {
    "claim": ("explicit", "pelt", "strong", "vintage"),
    "faux_near": ("words", "neighbours"),
    "description": ("faux", "faux_reactivated", "real"),
}
TIERS = {"brand": "fur_", "foreign": "fur_", "prime": "ambiguous_animal", "sampled": "ambiguous_animal"}
_PLAIN = re.compile(r"[0-9a-z_]+( [0-9a-z_]+)*")
_NAME = re.compile(r"[^',\\]+")


class RuleTableError(ValueError):
    """What is wrong with a rule table; all of it, one line each."""


def _problems(rows: list[dict]) -> list[str]:
    found, spellings = [], {r["rule"] for r in rows if r["rule_group"] == "spelling"}
    counters = {r["rule"] for r in rows if r["rule_group"] == "counter"}
    animals = {r["rule"] for r in rows if r["rule_group"] == "ambiguous_animal"}
    for at, row in enumerate(rows):
        group, name, listed, place = (row[c] for c in ("rule_group", "rule", "terms", "position"))
        said = f"rule {name!r} of group {group!r}"
        if group not in GROUPS:
            found.append(f"row {at}: there is no group {group!r}")
            continue
        if not name or not _NAME.fullmatch(name):
            found.append(f"{said}: a name has no quotes, commas or backslashes and is not empty")
        if row["surface"] != GROUPS[group][0]:
            found.append(f"{said}: its surface is {GROUPS[group][0]!r}, not {row['surface']!r}")
        if place is None:
            found.append(f"{said}: it has no position")
        if group in KNOWN and name not in KNOWN[group]:
            found.append(f"{said}: names here are {', '.join(KNOWN[group])}")
        for term in terms(listed) if listed else ("",):
            if group in PATTERNS:
                try:
                    re.compile(term)
                    fine = bool(term)
                except re.error:
                    fine = False
            else:
                fine = term in spellings or bool(_PLAIN.fullmatch(term))
            if not fine:
                found.append(f"{said}: {term!r} is neither words in lower case nor a known spelling" if group not in PATTERNS else f"{said}: {term!r} is no pattern")
        guard, tier = row["guard"], row["tier"]
        if group == "fur_hide" and guard not in animals:
            found.append(f"{said}: it needs an ambiguous animal as its guard, not {guard!r}")
        elif guard and group != "fur_hide" and guard not in counters:
            found.append(f"{said}: its guard {guard!r} is no counter")
        if guard and group not in ("sure_animal", "ambiguous_animal", "claim", "fur_hide"):
            found.append(f"{said}: rules of this group have no guard")
        if tier and not (tier in TIERS and group.startswith(TIERS[tier])):
            found.append(f"{said}: {tier!r} is no tier of this group")
    named = Counter((GROUPS[r["rule_group"]][1], r["rule"]) for r in rows if r["rule_group"] in GROUPS)
    found += [f"rule {name!r} stands twice in {kind}" for (kind, name), n in named.items() if n > 1]
    held = Counter(
        (GROUPS[r["rule_group"]][1], term)
        for r in rows
        if GROUPS.get(r["rule_group"], ("", ""))[1] in ("sure_animals", "ambiguous_animals", "fur_terms", "materials", "byproducts")
        for term in set(terms(r["terms"] or ""))
    )
    found += [f"term {term!r} belongs to two rules of {kind}" for (kind, term), n in held.items() if n > 1]
    return found


def bank_of(rows: list[dict]) -> Bank:
    """The bank that the rows of a rule table make; ``RuleTableError`` says what is wrong."""
    problems = _problems(rows)
    if problems:
        raise RuleTableError("\n".join(problems))
    rows = sorted(rows, key=lambda r: r["position"])
    fields: dict[str, dict[str, str]] = {kind: {} for _, kind in GROUPS.values()}
    for row in rows:
        fields[GROUPS[row["rule_group"]][1]][row["rule"]] = row["terms"]

    def names(group: str) -> tuple[str, ...]:
        return tuple(r["rule"] for r in rows if r["rule_group"] == group)

    return Bank(
        **fields,
        taxidermy=names("fur_taxidermy"),
        seal=names("fur_seal"),
        shown_only=names("fur_shown_only"),
        hide={r["rule"]: r["guard"] for r in rows if r["rule_group"] == "fur_hide"},
        guards={r["rule"]: r["guard"] for r in rows if r["guard"] and r["rule_group"] != "fur_hide"},
        tiers={r["rule"]: r["tier"] for r in rows if r["tier"]},
    )


def read_bank(table: DataFrame) -> Bank:
    """Compile a rule table. Its rows go to the driver, so their number is checked first."""
    missing = {c.split()[0] for c in SCHEMA.split(", ")} - set(table.columns)
    if missing:
        raise RuleTableError(f"columns are missing: {', '.join(sorted(missing))}")
    rows = table.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in SCHEMA.split(", ")]).limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise RuleTableError(f"more than {MOST_RULES} rules")
    return bank_of([row.asDict() for row in rows])


def _fur_group(bank: Bank, name: str) -> str:
    kinds = {"fur_taxidermy": bank.taxidermy, "fur_hide": bank.hide, "fur_seal": bank.seal, "fur_shown_only": bank.shown_only}
    return next((group for group, names in kinds.items() if name in names), "fur_evidence")


def rows_of(bank: Bank) -> list[tuple]:
    """The rows of a bank's table."""
    out = []
    for kind in dict.fromkeys(kind for _, kind in GROUPS.values()):
        group = next(g for g, (_, k) in GROUPS.items() if k == kind)
        for name, listed in getattr(bank, kind).items():
            own = _fur_group(bank, name) if kind == "fur_terms" else group
            guarded = own in ("sure_animal", "ambiguous_animal", "claim")
            guard = bank.hide.get(name) if own == "fur_hide" else bank.guards.get(name) if guarded else None
            tier = bank.tiers.get(name)
            tier = tier if tier and own.startswith(TIERS[tier]) else None
            out.append((own, name, GROUPS[own][0], listed, len(out), guard, tier))
    return out


def bank_table(spark: SparkSession, bank: Bank) -> DataFrame:
    """A bank as a rule table, to be stored, changed and read again."""
    return spark.createDataFrame(rows_of(bank), SCHEMA)
