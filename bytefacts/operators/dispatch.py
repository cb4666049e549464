"""Words of any dialect to their effects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytefacts.functions import words
from bytefacts.operators import lift, lift54, lift55

DIALECTS = {"lua5.1": "5.1", "lua5.1-stock32": "5.1", "lua5.1-lnum32": "5.1", "lua5.2": "5.2", "lua5.3": "5.3", "lua5.4": "5.4", "lua5.5": "5.5"}
EFFECTS = ("mnemonic", "reads", "writes", "metamethod", "skip_target", "jump_target", "invalid_from")


def lifted(rows: DataFrame, by: list[str], profile: str = "profile") -> DataFrame:
    """Words (by, profile, pc, raw_word) with EFFECTS, each by its own dialect; a profile that is not known has no rows."""
    out = []
    for dialect in dict.fromkeys(DIALECTS.values()):
        mine = rows.where(F.col(profile).isin(*(p for p, d in DIALECTS.items() if d == dialect)))
        decoded = words.decode(mine, dialect)
        made = lift54.lift(decoded) if dialect == "5.4" else lift55.lift(decoded, by) if dialect == "5.5" else lift.lift(decoded, dialect)
        out.append(made.select(*rows.columns, *EFFECTS))
    return reduce(DataFrame.unionByName, out)
