"""Settings of the risk model, as frozen dataclasses passed to the operators."""

from __future__ import annotations

from dataclasses import dataclass, field

# Text placeholders written by the cleaner and read by the flags.
NO_TEXT = "Sin información"
NO_DATE = "Sin fecha"
SENTINELS = (NO_TEXT, NO_DATE, "")

# Outcome labels after normalisation.
WON = "won"
LOST = "lost"
OTHER = "other"

# Tender-level columns carried from the first offer line of each tender.
HEADER_COLUMNS = (
    "tender_id", "tender_type", "estimate", "estimate_visible", "estimate_basis",
    "funding", "justification", "published_at", "closed_at", "awarded_at", "status",
    "call_type", "n_stages", "subcontracting", "comptroller_review",
    "technical_offers_public", "payment_type", "buyer_name", "buyer_id", "institution",
    "category_1", "category_2", "public_works",
)

# The seven 0/1 structural flags, in display order.
TIER1_FLAGS = (
    "single_bidder", "short_window", "express_evaluation", "weekend_publication",
    "round_amount", "ratio_near_one", "empty_justification",
)

BASE_FEATURES = (
    "n_bidders", "n_items", "days_open", "days_to_award", "awarded_amount", "estimate",
    "award_ratio", "runner_up_margin", "supplier_share", "buyer_share", "prior_pair",
)
LEXICAL_FEATURES = ("sim_won_tfidf", "sim_lost_tfidf", "delta_sim_tfidf")
DENSE_FEATURES = ("sim_won_dense", "sim_lost_dense", "delta_sim_dense")


@dataclass(frozen=True)
class CleaningRules:
    """What the cleaner drops, fills and filters. Defaults use the CSV header names."""

    key: str = "NroLicitacion"
    amount_columns: tuple[str, ...] = ("MontoNetoOferta", "MontoTotalOferta")
    max_null_pct: float = 90.0
    date_name_parts: tuple[str, ...] = ("fecha", "date")
    impute_exclude: tuple[str, ...] = ()


@dataclass(frozen=True)
class FlagRules:
    """Cut-offs of the structural flags."""

    short_window_days: float = 5.0
    express_days: float = 1.0
    round_step: float = 1_000_000.0
    ratio_low: float = 0.99
    ratio_high: float = 1.01
    visible_value: str = "Si"


@dataclass(frozen=True)
class RuleWeights:
    """Weights and cut-offs of the additive rule score (fixed values)."""

    flags: dict[str, float] = field(default_factory=lambda: {
        "single_bidder": 3.0,
        "short_window": 2.0,
        "express_evaluation": 1.0,
        "weekend_publication": 1.0,
        "round_amount": 0.5,
        "ratio_near_one": 2.5,
        "empty_justification": 0.5,
    })
    captive_supplier: float = 2.0
    captive_share: float = 0.8
    intense_relation: float = 1.5
    intense_min_awards: int = 10
    tailored_spec: float = 2.0
    tailored_min_delta: float = 0.2
    hot_community: float = 1.5


@dataclass(frozen=True)
class TextSettings:
    """Vocabulary of the lexical similarity; ``max_terms`` None keeps every term of enough texts."""

    max_terms: int | None = 30_000
    min_texts: int = 3


@dataclass(frozen=True)
class ForestSettings:
    """Isolation forest and its temporal split."""

    n_trees: int = 200
    sample_size: int = 256
    contamination: float = 0.05
    seed: int = 42
    cut_year: int = 2024


@dataclass(frozen=True)
class GraphSettings:
    """Community detection on the buyer-supplier graph.

    A level ends after two sweeps in a row that raise modularity by less than
    ``min_rise``. ``max_sweeps`` and ``max_levels`` are bounds that raise when they are hit;
    without them the search runs until modularity stops rising.
    """

    resolution: float = 1.0
    max_sweeps: int | None = None
    max_levels: int | None = None
    min_rise: float = 1e-7
    fit_until: int | None = None


@dataclass(frozen=True)
class ScoringSettings:
    """Everything the composite scoring job needs."""

    flags: FlagRules = FlagRules()
    weights: RuleWeights = field(default_factory=RuleWeights)
    text: TextSettings = TextSettings()
    forest: ForestSettings = ForestSettings()
    graph: GraphSettings = GraphSettings()
    rules_share: float = 0.6
    forest_share: float = 0.4
    null_counts_as_bidder: bool = False
    history_order: str = "published_at"
