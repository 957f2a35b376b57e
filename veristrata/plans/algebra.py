"""Closed query algebra: six intents, five metrics, four filter types; the plan picks a DataFrame template."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import digest
from ..operators import facts

INTENTS = ("assembly_detail", "locus_detail", "list_loci", "list_assemblies", "list_source_taxa", "aggregate")
#: Fixed order of filters in a plan.
FILTER_ORDER = (facts.GroupFilter, facts.LocusFilter, facts.LineageFilter, facts.CategoryFilter)
ALLOWED = {
    "assembly_detail": (facts.GroupFilter,),
    "locus_detail": (facts.LocusFilter,),
    "list_loci": (facts.GroupFilter, facts.LineageFilter, facts.CategoryFilter),
    "list_assemblies": (facts.LineageFilter, facts.CategoryFilter),
    "list_source_taxa": (facts.CategoryFilter,),
    "aggregate": (facts.GroupFilter, facts.LineageFilter, facts.CategoryFilter),
}


class Refused(ValueError):
    """A request outside the algebra; ``code`` says why."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


@dataclass(frozen=True)
class Plan:
    intent: str
    release: str
    filters: tuple = ()
    metric: str | None = None
    limit: int = 50
    after: tuple | None = None

    def __post_init__(self) -> None:
        if self.intent not in INTENTS:
            raise Refused("unsupported_intent", self.intent)
        if (self.intent == "aggregate") != (self.metric is not None) or (self.metric and self.metric not in facts.METRICS):
            raise Refused("unsupported_metric", str(self.metric))
        kinds = [type(f) for f in self.filters]
        if len(kinds) > 3 or len(set(kinds)) != len(kinds) or not set(kinds) <= set(ALLOWED[self.intent]):
            raise Refused("unsupported_filters")
        if not 1 <= self.limit <= 100:
            raise Refused("invalid_page_limit")
        object.__setattr__(self, "filters", tuple(sorted(self.filters, key=lambda f: FILTER_ORDER.index(type(f)))))

    def identity(self) -> str:
        """Digest of the plan without its page position."""
        own = {k: v for k, v in asdict(self).items() if k not in ("after", "filters")}
        return digest(own | {"filters": [[type(f).__name__, {k: str(v) for k, v in asdict(f).items()}] for f in self.filters]})


#: Sort keys of the lists.
SORT_KEYS = {"list_loci": ("group_id", "locus_id"), "list_assemblies": ("group_id",), "list_source_taxa": ("term_id",)}


def execute(plan: Plan, t: facts.Facts) -> DataFrame:
    base = facts.matched_loci(t, plan.release, plan.filters)
    if plan.intent == "aggregate":
        return facts.metric(t, base, plan.metric)
    if plan.intent in ("locus_detail", "assembly_detail"):
        return facts.locus_details(t, base)
    rows = {"list_loci": lambda: base, "list_assemblies": lambda: facts.group_rows(t, base), "list_source_taxa": lambda: facts.taxon_rows(t, base)}[plan.intent]()
    return facts.keyset_page(rows, list(SORT_KEYS[plan.intent]), plan.limit, plan.after)


def total(plan: Plan, t: facts.Facts) -> DataFrame:
    """Rows of a list before any page position."""
    base = facts.matched_loci(t, plan.release, plan.filters)
    key = {"list_loci": "locus_id", "list_assemblies": "group_id"}.get(plan.intent)
    if key:
        return base.agg(F.count_distinct(key).alias("total"))
    return facts.taxon_rows(t, base).agg(F.count("*").alias("total"))
