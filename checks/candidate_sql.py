"""SQL of the candidate strategies, shared by several queries."""

from __future__ import annotations

from cartwheel.operators.candidates import FAMILIES, FIRST_STRATEGY, NEW_ARTICLE_STRATEGY, WINDOW_KEYS
from checks.views import since

TARGETS = "SELECT DISTINCT customer_id FROM targ"


def frequent(window="all", n=12, rel="hist", where=None, count="count(*)", order="cnt DESC"):
    return f"""SELECT customer_id, article_id, cnt, CAST(row_number() OVER (PARTITION BY customer_id ORDER BY {order}, article_id) - 1 AS INTEGER) AS r
        FROM (SELECT customer_id, article_id, {count} AS cnt, max(t_dat) AS latest FROM {rel} WHERE {where or since(window, rel)} GROUP BY 1, 2)
        QUALIFY r < {n}"""


def popular(window="all", n=12, rel="hist", where="TRUE", span=None):
    return f"""SELECT article_id, cnt, CAST(row_number() OVER (ORDER BY cnt DESC, article_id) - 1 AS INTEGER) AS r
        FROM (SELECT article_id, count(*) AS cnt FROM {rel} WHERE {span or since(window, rel)} AND {where} GROUP BY 1) QUALIFY r < {n}"""


def newest(n=48, rel="fc"):
    return f"""SELECT article_id, "1st_week_sales_pred", CAST(row_number() OVER (ORDER BY "1st_week_sales_pred" DESC, article_id) - 1 AS INTEGER) AS r
        FROM {rel} QUALIFY r < {n}"""


def for_targets(listed):
    return f"SELECT customer_id, article_id, r FROM ({TARGETS}) CROSS JOIN ({listed})"


def _lists(column, window, n, rel):
    return f"""SELECT {column}, article_id, CAST(row_number() OVER (PARTITION BY {column} ORDER BY count(*) DESC, article_id) - 1 AS INTEGER) AS r
        FROM {rel} WHERE {since(window, rel)} GROUP BY 1, 2 QUALIFY r < {n}"""


def segment(window="all", n=12, rel="hist_wide"):
    return f"""SELECT customer_id, article_id, r FROM (SELECT DISTINCT customer_id, customer_type FROM {rel} WHERE {since(window, rel)})
        JOIN ({_lists('customer_type', window, n, rel)}) USING (customer_type)"""


def favourite(column, window="all", rel="hist_wide"):
    return f"""SELECT customer_id, {column} FROM {rel} WHERE {since(window, rel)} GROUP BY 1, 2
        QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY count(*) DESC, {column}) = 1"""


def attribute(column, window="all", n=12, rel="hist_wide"):
    return f"SELECT customer_id, article_id, r FROM ({favourite(column, window, rel)}) JOIN ({_lists(column, window, n, rel)}) USING ({column})"


def tagged(ns, n_new=48):
    """All strategies for the target customers: customer_id, article_id, s, r."""
    parts = []
    for key, window in WINDOW_KEYS.items():
        bodies = {"cf": frequent(window, ns[f"cf_{key}"], "hist_wide"), "ctf": segment(window, ns[f"ctf_{key}"]),
                  "atfd": attribute("department_name", window, ns[f"atfd_{key}"]),
                  "atfp": attribute("perceived_colour_master_name", window, ns[f"atfp_{key}"]),
                  "pa": for_targets(popular(window, ns[f"pa_{key}"], "hist_wide"))}
        for i, family in enumerate(FAMILIES):
            parts.append(f"SELECT customer_id, article_id, {FIRST_STRATEGY[key] + i} AS s, r FROM ({bodies[family]})")
    parts.append(f"SELECT customer_id, article_id, {NEW_ARTICLE_STRATEGY} AS s, r FROM ({for_targets(newest(n_new))})")
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE customer_id IN ({TARGETS})"


def simple_tagged(windows, n=12):
    """Own and global best sellers per window, numbered in order."""
    parts = []
    for i, w in enumerate(windows):
        parts.append(f"SELECT customer_id, article_id, {2 * i} AS s, r FROM ({frequent(w, n)}) WHERE customer_id IN ({TARGETS})")
        parts.append(f"SELECT customer_id, article_id, {2 * i + 1} AS s, r FROM ({for_targets(popular(w, n))})")
    return " UNION ALL ".join(parts)


SAME_DAY = """SELECT article_id, partner_id, cnt FROM (
    SELECT a.article_id, b.article_id AS partner_id, count(*) AS cnt FROM {rel} a JOIN {rel} b USING (customer_id, t_dat)
    WHERE a.article_id <> b.article_id GROUP BY 1, 2)
    QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY cnt DESC, partner_id) = 1"""

SAME_CUSTOMER = """SELECT article_id, partner_id, cnt FROM (
    SELECT a.article_id, b.article_id AS partner_id, count(*) AS cnt
    FROM (SELECT DISTINCT customer_id, article_id FROM {rel} WHERE {where}) a JOIN (SELECT * FROM {rel} WHERE {where}) b USING (customer_id)
    WHERE a.article_id <> b.article_id GROUP BY 1, 2)
    QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY cnt DESC, partner_id) = 1"""


def expanded(cand, partners, distinct=True):
    """Partner of every candidate, ranked in candidate order."""
    base = f"""SELECT customer_id, partner_id AS article_id, c.s AS s, c.r AS r, c.article_id AS via FROM {cand} c JOIN {partners} p ON c.article_id = p.article_id"""
    if distinct:
        base = f"""SELECT * FROM ({base}) QUALIFY row_number() OVER (PARTITION BY customer_id, article_id ORDER BY s, r, via) = 1"""
    return f"""SELECT customer_id, article_id, 21 AS s, CAST(row_number() OVER (PARTITION BY customer_id ORDER BY s, r, via, article_id) - 1 AS INTEGER) AS r FROM ({base})"""
