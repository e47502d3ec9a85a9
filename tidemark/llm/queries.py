"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from . import html_extract, license_scan, line_dedup, mixing, packing, quality_rules, secret_scan, simhash, token_planes, vector_tree


def queries() -> dict:
    return {
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op2_license_scan": license_scan.op2_license_scan,
        "op3_packing": packing.op3_packing,
        "op4_quality_rules": quality_rules.op4_quality_rules,
        "op5_token_planes": token_planes.op5_token_planes,
        "op6_mixing": mixing.op6_mixing,
        "op7_html_extract": html_extract.op7_html_extract,
        "op8_simhash": simhash.op8_simhash,
        "op9_secret_scan": secret_scan.op9_secret_scan,
        "op10_vector_tree": vector_tree.op10_vector_tree,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": line_dedup.OP1_SQL, "op2_license_scan": license_scan.OP2_SQL, "op6_mixing": mixing.OP6_SQL}
