"""Configuration: defaults, layering, bank overlays and checks. Lives on the driver; only phrase lists and literals reach plans."""

from __future__ import annotations

import copy
import json
from typing import Any

REGIONS = ("EnglandAndWales", "Scotland", "NorthernIreland")
DEFAULT_REGION = REGIONS[0]


class ConfigError(ValueError):
    pass


#: Seed vocabulary and in-code defaults; fixed values.
DEFAULTS: dict[str, Any] = {
    "weights": {"date_pattern_score": 0.30, "description_similarity_score": 0.25, "amount_consistency_score": 0.20, "payment_channel_score": 0.10, "coverage_score": 0.10, "context_bonus": 0.05},
    "penalties": {"max_negative_signal_penalty": -0.20},
    "bonuses": {"per_anchor": 0.05, "max_anchor_bonus": 0.15},
    "thresholds": {"return_threshold": 0.40},
    "candidate_generation": {
        "min_skeleton_group_size": 2, "skeleton_plausibility_threshold": 0.45, "graph_edge_threshold": 0.55,
        "dedup_txn_id_overlap_pct": 0.90, "max_candidates_to_return": 10, "max_near_misses": 10,
    },
    "amount": {"stable_pct_tolerance": 0.02, "moderate_pct_tolerance": 0.10, "step_change_min_pct": 0.05, "variable_max_cv": 0.30, "outlier_mad_ratio": 3.0},
    "calendar": {"default_region": DEFAULT_REGION},
    "channels": {
        "bacs_or_direct_credit": {"positive_tokens": ["BACS", "BAC", "BGC", "DIRECT CREDIT"]},
        "faster_payment": {"positive_tokens": ["FPI", "FPS", "FP", "FASTER PAYMENT"]},
        "chaps": {"positive_tokens": ["CHAPS", "CHP"]},
        "cheque": {"positive_tokens": ["CHQ"]},
        "cash_or_counter_credit": {"positive_tokens": ["CASH", "CDM", "TLR"]},
        "internal_transfer": {"positive_tokens": ["ITL", "TFR"]},
        "international_credit": {"positive_tokens": ["IBAN", "SWIFT"]},
        "standing_order_credit": {"positive_tokens": ["STO"]},
    },
    "salary_hints": {"strong": ["PAYROLL", "SALARY", "WAGES", "WAGE"], "medium": ["STAFF PAY", "MONTHLY PAY", "STAFF"], "weak": ["PAY"]},
    "negative_salary_signals": {
        "government_benefits": ["DWP", "UNIVERSAL CREDIT", "CHILD BENEFIT", "PIP"],
        "tax_refund": ["HMRC", "TAX REFUND"],
        "pension": ["PENSION", "RETIREMENT"],
        "investment_income": ["DIVIDEND", "INTEREST"],
        "own_transfers": ["OWN ACCOUNT", "SAVINGS", "TRANSFER FROM SAVINGS", "TRANSFER FROM OWN"],
        "other": ["RENT", "INSURANCE", "MARKETPLACE"],
    },
    "regions": {},
    "versions": {"config": "1"},
}


def deep_merge(base: dict, overlay: dict) -> dict:
    """Dicts merge key by key, lists append what they do not hold yet, anything else is replaced."""
    out = copy.deepcopy(base)
    for k, v in overlay.items():
        have = out.get(k)
        if isinstance(have, dict) and isinstance(v, dict):
            out[k] = deep_merge(have, v)
        elif isinstance(have, list) and isinstance(v, list):
            out[k] = list(dict.fromkeys([*map(_frozen, have), *map(_frozen, v)]))
        else:
            out[k] = copy.deepcopy(v)
    return out


def _frozen(x: Any) -> Any:
    return x if isinstance(x, str | int | float | bool | None) else json.dumps(x, sort_keys=True)


def bank_overlay(base: dict, overlay: dict) -> dict:
    """Channels gain positive tokens, negative signals gain tokens; nothing else of an overlay counts."""
    extra: dict[str, Any] = {"channels": {}, "negative_salary_signals": overlay.get("negative_salary_signals") or {}}
    for name, channel in (overlay.get("channels") or {}).items():
        extra["channels"][name] = {"positive_tokens": channel.get("positive_tokens") or []}
    return deep_merge(base, extra)


def check(data: dict) -> None:
    """Raises on the first fault."""
    w = data.get("weights", {})
    if set(w) != set(DEFAULTS["weights"]):
        raise ConfigError(f"weights must be exactly {sorted(DEFAULTS['weights'])}")
    for block in ("weights", "penalties", "bonuses", "thresholds", "amount", "candidate_generation"):
        for k, v in data.get(block, {}).items():
            if isinstance(v, bool) or not isinstance(v, int | float):
                raise ConfigError(f"{block}.{k} must be a number")
    if any(not 0 <= v <= 1 for v in w.values()):
        raise ConfigError("weights lie between 0 and 1")
    if data.get("penalties", {}).get("max_negative_signal_penalty", 0) > 0:
        raise ConfigError("max_negative_signal_penalty must not be positive")
    if data.get("calendar", {}).get("default_region", DEFAULT_REGION) not in (*REGIONS, "UnknownDefaultEnglandAndWales"):
        raise ConfigError("unknown default_region")


class Config:
    """Layered settings: defaults, bank overlay, files, the caller's values."""

    def __init__(self, overrides: dict | None = None, files: tuple[str, ...] = (), source_bank: str | None = None, overlays: dict[str, dict] | None = None):
        data = copy.deepcopy(DEFAULTS)
        if source_bank is not None and (overlay := (overlays or {}).get(source_bank)) is not None:
            data = bank_overlay(data, overlay)
            data["source_bank"] = source_bank
        for f in files:
            data = deep_merge(data, read_file(f))
        self.data = deep_merge(data, overrides or {})
        check(self.data)

    def get(self, *path: str, default: Any = None) -> Any:
        at: Any = self.data
        for k in path:
            if not isinstance(at, dict) or k not in at:
                return default
            at = at[k]
        return at

    # phrase tables, in the order in which they match
    def channel_phrases(self) -> list[tuple[str, str]]:
        return [(name, " ".join(t.upper().split())) for name, c in self.data["channels"].items() for t in c.get("positive_tokens", []) if t.strip()]

    def hint_phrases(self) -> list[tuple[str, str]]:
        """(strength, phrase): several words first, longest and then by strength; single words keep the text's order."""
        all_ = [(s, " ".join(t.upper().split())) for s in ("strong", "medium", "weak") for t in self.data["salary_hints"].get(s) or [] if t.strip()]
        several = sorted((x for x in all_ if " " in x[1]), key=lambda x: (-x[1].count(" "), x[0]))
        return several + [x for x in all_ if " " not in x[1]]

    def negative_phrases(self) -> list[tuple[str, str]]:
        all_ = [(c, " ".join(t.upper().split())) for c, ts in self.data["negative_salary_signals"].items() for t in ts or []]
        return sorted(all_, key=lambda x: (-x[1].count(" "), x[0]))


def read_file(path: str) -> dict:
    """A JSON or YAML file with one mapping."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        data = json.loads(text)
    else:
        import yaml

        data = yaml.safe_load(text)
    if not isinstance(data, dict | None):
        raise ConfigError(f"{path} does not hold a mapping")
    return data or {}
