"""Queries and oracle SQL of the corpus operators."""

from __future__ import annotations

from . import audit, copies, decontaminate, exact, langid, lattice, lm, mixing, pii, runs, simhash, sstable, subword

QUERIES = {
    "op5_suffix": exact.op5_suffix,
    "op1_lm": lm.op1_lm,
    "op9_lattice": lattice.op9_lattice,
    "op8_langid": langid.op8_langid,
    "op3_pii": pii.op3_pii,
    "op7_quality": subword.op7_quality,
    "op2_sstable": sstable.op2_sstable,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op6_mixing": mixing.op6_mixing,
    "op10_simhash": simhash.op10_simhash,
    "op11_runs": runs.op11_runs,
    "op12_copies": copies.op12_copies,
    "op13_audit": audit.op13_audit,
}

ORACLE = {"op4_decontaminate": decontaminate.OP4_SQL, "op5_suffix": exact.OP5_SQL, "op6_mixing": mixing.OP6_SQL, "op9_lattice": lattice.OP9_SQL, "op11_runs": runs.OP11_SQL, "op12_copies": copies.OP12_SQL, "op13_audit": audit.OP13_SQL}
