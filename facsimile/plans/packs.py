"""Registry of built-in dataset packs: generator, contract and checks."""

from __future__ import annotations

from facsimile.operators import checks
from facsimile.plans import fintech, retail

PACKS = {
    "retail": {"generate": retail.generate_retail, "contract": retail.retail_contract, "checks": checks.retail_checks},
    "fintech": {"generate": fintech.generate_fintech, "contract": fintech.fintech_contract,
                "checks": checks.fintech_checks},
}


def pack(name: str) -> dict:
    if name not in PACKS:
        raise KeyError(f"unknown pack {name!r}; known: {sorted(PACKS)}")
    return PACKS[name]
