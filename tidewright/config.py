"""Settings of the stages, with presets: what is given explicitly wins over the preset, and that over the default."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, fields, replace
from typing import Any, TypeVar


@dataclass(frozen=True)
class Fetch:
    input: str | None = None
    out: str = "data"
    per_ticker: bool = False
    batch_size: int = 30
    incremental: bool = False
    actions: bool = False
    adjusted_only: bool = False
    compression: str = "snappy"
    partition_by: str | None = None
    only: str | None = None
    validate_only: bool = False
    dry_run: bool = False
    fail_on_empty: int | None = None
    log_file: str | None = None
    float_dp: int | None = None


@dataclass(frozen=True)
class Features:
    input: str | None = None
    out: str = "features.parquet"
    csv: str | None = None
    ma: tuple[int, ...] = (20, 50, 200)
    rsi: int = 14
    use_adjclose: bool = False
    partition_by: str | None = None
    float_dp: int | None = None


@dataclass(frozen=True)
class Windows:
    input: str | None = None
    out: str = "rebased"
    per_ticker: bool = False
    before: int = 50
    after: int = 50
    float_dp: int | None = None
    format: str = "csv"
    drop_rows_if_nan: str = "all"
    csv_head: int | None = None
    csv_tail: int | None = None
    require_full_window: bool = False


@dataclass(frozen=True)
class Match:
    watch: str | None = None
    ref_dir: str = "rebased"
    lookback: int = 75
    horizon: int = 25
    topn: int = 10
    metric: str = "mse"
    match_cols: str = "AdjClose_Rebased,MA_20_Rebased,MA_50_Rebased,MA_200_Rebased"
    weights: str = ""
    out_dir: str = "analog_out"
    query_from_features: bool = False
    query_features_dir: str = "features.parquet"


_FETCH = {"input": "tickers.csv", "out": "data_all", "batch_size": 30, "compression": "snappy", "float_dp": 4, "partition_by": "Ticker", "incremental": True}
#: Fixed values of the presets.
PRESETS: dict[type, dict[str, dict[str, Any]]] = {
    Fetch: {"standard": {**_FETCH, "actions": True}, "fast": {**_FETCH, "batch_size": 20}, "validate": {"input": "tickers.csv", "out": "data_all", "validate_only": True}},
    Features: {"standard": {"out": "features.parquet", "partition_by": "Ticker", "csv": "features.csv", "use_adjclose": True, "ma": (20, 50, 200), "rsi": 14, "float_dp": 4}},
    Windows: {
        "standard": {
            "input": "features.parquet",
            "out": "rebased",
            "before": 75,
            "after": 25,
            "per_ticker": True,
            "float_dp": 4,
            "format": "both",
            "csv_head": 1000,
            "csv_tail": 1000,
            "drop_rows_if_nan": "any",
            "require_full_window": True,
        }
    },
    Match: {},
}
C = TypeVar("C", Fetch, Features, Windows, Match)


def configured(kind: type[C], preset: str | None = None, **given: Any) -> C:
    if preset is not None and preset not in PRESETS[kind]:
        raise ValueError(f"no preset {preset!r} for {kind.__name__}")
    return replace(kind(), **{**(PRESETS[kind][preset] if preset else {}), **given})


def from_flags(kind: type[C], argv: list[str]) -> C:
    """Settings from command-line flags, `--flag value` or `--flag=value`; without any flag, the standard preset."""
    parser = argparse.ArgumentParser(argument_default=argparse.SUPPRESS)
    parser.add_argument("--preset", choices=sorted(PRESETS[kind]))
    for f in fields(kind):
        flag = f"--{f.name.replace('_', '-')}"
        if f.name == "ma":
            parser.add_argument(flag, nargs="+", type=int)
        elif f.default is False:
            parser.add_argument(flag, action="store_true")
        else:
            number = f.name in ("batch_size", "fail_on_empty", "float_dp", "rsi", "before", "after", "csv_head", "csv_tail", "lookback", "horizon", "topn")
            parser.add_argument(flag, *{"input": ["-i"], "out": ["-o"]}.get(f.name, []), type=int if number else str)
    given = vars(parser.parse_args(argv))
    preset = given.pop("preset", None if argv or "standard" not in PRESETS[kind] else "standard")
    if "ma" in given:
        given["ma"] = tuple(given["ma"])
    return configured(kind, preset, **given)
