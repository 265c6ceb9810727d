"""python -m leadweave build ROOT [--artifacts DIR] [--leads N] [--seed N] [--as-of DATE] [--lookback-days N]."""

from __future__ import annotations

import argparse
import json
from datetime import date

from .config import DEFAULT_AS_OF, DEFAULT_LEADS, DEFAULT_SEED, session
from .plans.build import build


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="leadweave")
    run = parser.add_subparsers(dest="command", required=True).add_parser("build", help="generate, load, check, train, score and report")
    run.add_argument("root", help="folder of tables and the model, on any store")
    run.add_argument("--artifacts", help="local folder of the documents (root/artifacts)")
    run.add_argument("--leads", type=int, default=DEFAULT_LEADS)
    run.add_argument("--seed", type=int, default=DEFAULT_SEED)
    run.add_argument("--as-of", type=date.fromisoformat, default=DEFAULT_AS_OF)
    run.add_argument("--lookback-days", type=int, default=365)
    run.add_argument("--rounds", type=int, help="rounds of boosting")
    own = parser.parse_args(args)
    more = {"rounds": own.rounds} if own.rounds else {}
    out = build(session(), own.root, own.artifacts or f"{own.root}/artifacts", own.leads, own.seed, own.as_of, own.lookback_days, **more)
    print(json.dumps({"quality": out["quality"]["status"], "model": out["model"]["selected_model"], "test": out["model"]["selected_test_metrics"], "maximum_psi": out["monitoring"]["maximum_psi"]}))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
