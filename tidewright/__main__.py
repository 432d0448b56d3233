"""The stages from the command line: python -m tidewright STAGE [--flag value ...]

fetch, features, windows, match: one stage; its flags are the settings of tidewright.config.
run: fetch, features and windows with their standard presets.
diff LEFT RIGHT: whether two copies of a table are alike.

fetch, run and match take --quotes FOLDER for quotes from Parquet files; without it, quotes come from the network.
Exit codes: 0; 1 for wrong usage or more empty series than allowed; 2 for files that are missing.
"""

from __future__ import annotations

import importlib.util
import sys

from pyspark.sql import SparkSession

from .config import Features, Fetch, Match, Windows, configured, from_flags
from .plans import stages
from .session import session
from .sources.quotes import FolderProvider, NetworkProvider, Provider, network


def provider_of(argv: list[str]) -> tuple[Provider, list[str]]:
    """The provider that --quotes names, and the other arguments."""
    if "--quotes" not in argv[:-1]:
        return NetworkProvider(), argv
    at = argv.index("--quotes")
    return FolderProvider(argv[at + 1]), argv[:at] + argv[at + 2 :]


def main(argv: list[str], spark: SparkSession | None = None) -> int:
    name, rest = (argv[0], argv[1:]) if argv else ("", [])
    if name not in ("fetch", "features", "windows", "match", "run", "diff") or (name == "diff" and len(rest) != 2):
        print(__doc__, file=sys.stderr)
        return 1
    spark = spark or session()
    provider, rest = provider_of(rest)
    try:
        if name in ("fetch", "run") and isinstance(provider, NetworkProvider):
            network()
        if name == "fetch":
            got = stages.fetch_stage(spark, from_flags(Fetch, rest), provider)
            for row in got.missing.orderBy("ticker").collect() if got else []:  # of the list after --only
                print(f"not in the list: {row.ticker}", file=sys.stderr)
        elif name == "features":
            stages.features_stage(spark, from_flags(Features, rest))
        elif name == "windows":
            stages.windows_stage(spark, from_flags(Windows, rest))
        elif name == "match":
            known = isinstance(provider, FolderProvider) or importlib.util.find_spec("yfinance") is not None
            _, _, status = stages.match_stage(spark, from_flags(Match, rest), provider if known else None)
            status.show(truncate=False)
        elif name == "run":
            stages.fetch_stage(spark, configured(Fetch, "standard"), provider)
            stages.features_stage(spark, configured(Features, "standard"))
            stages.windows_stage(spark, configured(Windows, "standard"))
        else:
            verdict = stages.diff_stage(spark, *rest)
            if verdict is None:
                print("a file is missing", file=sys.stderr)
                return 2
            verdict.show(truncate=False)
    except (RuntimeError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
