"""Contracts, wallets, operators and gas on the stand-in market.

A wallet is known (tx_from not NULL) where its pair with the sender occurs at least four times; thresholds are scaled
to that. Trigger, response time and gas columns are functions of the event."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import market as m
from checks.market import with_parts
from checks.q_response import CEX, interval_ms, DT_SQL, concentration_sql, mean_if
from checks.registry import query
from checks.rounding import rounded
from tideline.operators.graph import connected_components
from tideline.plans import operators as op
from tideline.session import stored

WALLETS, MEDIAN, MIN_ARBS, PAIR_COUNT = 2, 4, 3, 4


@m.written
def arbs_with_tx(spark, sf):
    s = m.swaps(spark, sf)
    frequent = s.groupBy("sender", "tx_from").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= PAIR_COUNT).withColumn("_known", F.lit(True))
    j = s.join(frequent, ["sender", "tx_from"], "left")
    e, k = F.col("log_index"), F.col("liquidity") - 1
    wallet = F.when(F.col("_known"), F.col("tx_from"))
    return j.select(
        "pool", "block", "log_index", "sender", wallet.alias("tx_from"), F.when(e % 3 == 0, F.upper("sender")).otherwise(F.lit("router")).alias("tx_to"),
        F.element_at(F.array(*[F.lit(t) for t in ("cex", "same_block", "continuation", "onchain")]), (e % 4 + 1).cast("int")).alias("trigger"),
        F.pmod(e * 7919, F.lit(60_000)).alias("tau_ms"), (e % 3 + 1).alias("k_blocks"), F.col("p_post").alias("overshoot_bps"), F.col("p_post").alias("volume_q"),
        (F.col("p_post") / 10).alias("arb_loss"), ((k % 7 + 1) * 1_000_000_000 + e * 1000).cast("bigint").alias("gas_price_wei"), (e % 5000 + 100_000).alias("gas_used"),
        (e % 20).alias("tx_index"), F.lit(600.0).alias("native_price"), F.when(F.col("block") < m.CHANGE_BLOCK, "pre").otherwise("post").alias("regime"),
    )


m.PARTS["px"] = (("sw",), f"SELECT sender, tx_from, count(*) AS n FROM sw GROUP BY 1, 2 HAVING count(*) >= {PAIR_COUNT}")
m.PARTS["ox"] = (("sw", "px"), f"""
    SELECT s.pool, s.block, s.log_index, s.sender, p.tx_from AS tx_from, CASE WHEN s.log_index % 3 = 0 THEN upper(s.sender) ELSE 'router' END AS tx_to,
           CASE s.log_index % 4 WHEN 0 THEN 'cex' WHEN 1 THEN 'same_block' WHEN 2 THEN 'continuation' ELSE 'onchain' END AS trigger,
           (s.log_index * 7919) % 60000 AS tau_ms, s.log_index % 3 + 1 AS k_blocks, s.p_post AS overshoot_bps, s.p_post AS volume_q, s.p_post / 10 AS arb_loss,
           (CAST(s.liquidity - 1 AS BIGINT) % 7 + 1) * 1000000000 + s.log_index * 1000 AS gas_price_wei, s.log_index % 5000 + 100000 AS gas_used, s.log_index % 20 AS tx_index,
           CASE WHEN s.block < {m.CHANGE_BLOCK} THEN 'pre' ELSE 'post' END AS regime
    FROM sw s LEFT JOIN px p USING (sender, tx_from)""")
m.PARTS["ct"] = (("ox", "px"), f"""
    SELECT *, dw >= {WALLETS} AND med <= {MEDIAN} AS public, dw >= {WALLETS} AND NOT med <= {MEDIAN} AS wallet_rotation FROM (
      SELECT a.sender, a.dw, a.with_tx, a.med, a.top1, a.top3, b.arbs, b.pools, b.direct
      FROM (SELECT sender, count(*) AS dw, sum(n) AS with_tx, quantile_cont(n::DOUBLE, 0.5) AS med, max(n) FILTER (i = 1) / sum(n)::DOUBLE AS top1, sum(n) FILTER (i <= 3) / sum(n)::DOUBLE AS top3
            FROM (SELECT *, row_number() OVER (PARTITION BY sender ORDER BY n DESC, tx_from) AS i FROM px) GROUP BY 1) a
      JOIN (SELECT sender, count(*) AS arbs, count(DISTINCT pool) AS pools, avg(CASE WHEN lower(tx_to) = lower(sender) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS direct FROM ox GROUP BY 1) b USING (sender))""")
m.PARTS["ed"] = (("px", "ct"), """
    SELECT 'c:' || sender AS a, 'e:' || tx_from AS b FROM px WHERE sender NOT IN (SELECT sender FROM ct WHERE public)
    UNION SELECT 'e:' || tx_from, 'c:' || sender FROM px WHERE sender NOT IN (SELECT sender FROM ct WHERE public)""")
m.PARTS["cc"] = (("ed",), "SELECT a AS node, a AS label FROM ed UNION SELECT ed.b, cc.label FROM cc JOIN ed ON ed.a = cc.node")
m.PARTS["cl"] = (("cc",), "SELECT node, min(label) AS label FROM cc GROUP BY node")
m.PARTS["ol"] = (("ox", "ct", "cl"), f"""
    SELECT x.*, coalesce(c.public, false) AS via_public,
           CASE WHEN NOT coalesce(c.public, false) THEN coalesce(a.label, 'c:' || x.sender)
                ELSE coalesce(b.label, CASE WHEN h.tx_from IS NOT NULL THEN 'e:' || h.tx_from END, 'anon') END AS operator
    FROM ox x LEFT JOIN ct c USING (sender) LEFT JOIN cl a ON a.node = 'c:' || x.sender LEFT JOIN cl b ON b.node = 'e:' || x.tx_from
    LEFT JOIN (SELECT o.tx_from FROM ox o JOIN ct USING (sender) WHERE ct.public AND o.tx_from IS NOT NULL GROUP BY 1 HAVING count(*) >= {MIN_ARBS}) h ON h.tx_from = x.tx_from""")
m.PARTS["ot"] = (("px", "ct", "cl"), """
    SELECT cl.label AS operator, count(DISTINCT px.sender) AS contracts, count(DISTINCT px.tx_from) AS wallets, CAST(sum(px.n) AS BIGINT) AS arbs
    FROM px JOIN cl ON cl.node = 'c:' || px.sender WHERE px.sender NOT IN (SELECT sender FROM ct WHERE public) GROUP BY 1""")


def _operators(spark, sf):
    a = arbs_with_tx(spark, sf)
    return op.with_operators(a, op.contract_table(a, WALLETS, MEDIAN), MIN_ARBS)


def _labelled(spark, sf):
    """As in the job, the labelled arbitrages are written before tables are built on them."""
    labelled, operators = _operators(spark, sf)
    return stored(labelled, "labelled"), operators


@query("contract_table", with_parts("""
    SELECT sender, arbs, CAST(with_tx AS BIGINT) AS arbs_with_tx, dw AS distinct_wallets, round(med, 6) AS median_per_wallet, round(top1, 6) AS top_wallet_share, round(top3, 6) AS top3_wallet_share,
           pools, round(direct, 6) AS direct_share, public, wallet_rotation FROM ct""", "ct"))
def contract_table(spark, sf):
    return rounded(op.contract_table(arbs_with_tx(spark, sf), WALLETS, MEDIAN))


@query("classify_public", with_parts("SELECT public, wallet_rotation, count(*) AS n FROM ct GROUP BY 1, 2", "ct"))
def classify_public(spark, sf):
    return op.contract_table(arbs_with_tx(spark, sf), WALLETS, MEDIAN).groupBy("public", "wallet_rotation").agg(F.count(F.lit(1)).alias("n"))


@query("connected_operators", with_parts("SELECT pool, log_index, operator, via_public FROM ol", "ol"))
def connected_operators(spark, sf):
    return _operators(spark, sf)[0].select("pool", "log_index", "operator", "via_public")


@query("operator_table", with_parts("SELECT operator, contracts, wallets, arbs FROM ot", "ot"))
def operator_table(spark, sf):
    return _operators(spark, sf)[1]


@query("graph_components", with_parts("""
    , g2 AS (SELECT DISTINCT 'c' || user_id AS a, 'k' || k AS b FROM ev WHERE value > 150), e2 AS (SELECT a, b FROM g2 UNION SELECT b, a FROM g2),
    r2 AS (SELECT a AS node, a AS label FROM e2 UNION SELECT e2.b, r2.label FROM r2 JOIN e2 ON e2.a = r2.node)
    SELECT node AS member, min(label) AS component FROM r2 GROUP BY node""", "ev"))
def graph_components(spark, sf):
    e = m.events(spark, sf).filter("value > 150").select(F.concat(F.lit("c"), F.col("user_id")).alias("a"), F.concat(F.lit("k"), F.col("k")).alias("b"))
    return connected_components(e, "a", "b")


@query("flow_profiles", with_parts(f"""
    , fl AS (SELECT *, CASE WHEN NOT via_public THEN 'bot contracts' WHEN operator LIKE 'e:%' OR operator LIKE 'c:%' THEN 'router, persistent wallet' ELSE 'router, one-off wallet' END AS flow FROM ol)
    SELECT flow, n, wallets, round(same_block_share, 6) AS same_block_share, round(cex_share, 6) AS cex_share, round(p_first, 6) AS p_first, round(median_size, 6) AS median_size,
           round(median_overshoot, 6) AS median_overshoot, round(median_tau, 6) AS median_tau, round(median_per_wallet, 6) AS median_per_wallet, round(n / (SELECT count(*) FROM fl)::DOUBLE, 6) AS share
    FROM (SELECT flow, count(*) AS n, count(DISTINCT tx_from) AS wallets, {mean_if("trigger = 'same_block'", 'true')} AS same_block_share, {mean_if("trigger = 'cex'", 'true')} AS cex_share,
                 {mean_if('k_blocks = 1', CEX)} AS p_first, quantile_cont(volume_q, 0.5) AS median_size, quantile_cont(overshoot_bps, 0.5) AS median_overshoot, quantile_cont(tau_ms::DOUBLE, 0.5) FILTER ({CEX}) AS median_tau FROM fl GROUP BY 1)
    LEFT JOIN (SELECT flow, quantile_cont(n::DOUBLE, 0.5) AS median_per_wallet FROM (SELECT flow, tx_from, count(*) AS n FROM fl WHERE tx_from IS NOT NULL GROUP BY 1, 2) GROUP BY 1) USING (flow)""", "ol"))
def flow_profiles(spark, sf):
    return rounded(op.flow_profiles(_labelled(spark, sf)[0], m.MAX_TAU_MS))


@query("wallet_rotation", with_parts(f"""
    , pw AS (SELECT regime, sender, count(*) AS n, count(DISTINCT tx_from) AS wallets FROM ox GROUP BY 1, 2)
    SELECT regime, CAST(sum(n) AS BIGINT) AS arbs, count(*) FILTER (n >= 30) AS active_contracts, round(coalesce(sum(n) FILTER (wallets >= 30), 0) / sum(n)::DOUBLE, 6) AS share_ge30_wallets,
           round(coalesce(sum(n) FILTER (wallets >= 5), 0) / sum(n)::DOUBLE, 6) AS share_ge5_wallets, round(quantile_cont(wallets::DOUBLE, 0.5) FILTER (n >= 30), 6) AS median_wallets_active,
           string_agg(wallets::VARCHAR, ' / ' ORDER BY i) FILTER (i <= 5) AS top5_wallets
    FROM (SELECT *, row_number() OVER (PARTITION BY regime ORDER BY n DESC, sender) AS i FROM pw) GROUP BY regime""", "ox"))
def wallet_rotation(spark, sf):
    return rounded(op.wallet_rotation(arbs_with_tx(spark, sf), ["regime"], active=30))


@query("gas_position", with_parts(f"""
    , gs AS (SELECT *, gas_price_wei / 1e9::DOUBLE AS g, gas_price_wei / 1e9::DOUBLE * gas_used / 1e9::DOUBLE * 600.0 AS cost FROM ox),
    md AS (SELECT regime, trigger, quantile_cont(g, 0.5) AS gas_median FROM gs GROUP BY 1, 2)
    SELECT regime, trigger, count(*) AS n, round({mean_if('tx_index = 0', 'true')}, 6) AS share_first, round({mean_if('tx_index <= 2', 'true')}, 6) AS share_top3, round(sum(cost) / sum(arb_loss), 6) AS gas_over_gain,
           round(max(gas_median), 6) AS gas_median, round(quantile_cont(g, 0.9), 6) AS gas_p90, round(quantile_cont(gas_used::DOUBLE, 0.5), 6) AS gas_used_median, round(quantile_cont(tx_index::DOUBLE, 0.5), 6) AS tx_index_median,
           round(quantile_cont(cost, 0.5), 6) AS cost_median, round(quantile_cont(arb_loss, 0.5), 6) AS gain_median, round({mean_if('g > 1.5 * gas_median', 'true')}, 6) AS share_above_1_5_median
    FROM gs JOIN md USING (regime, trigger) GROUP BY 1, 2""", "ox"))
def gas_position(spark, sf):
    return rounded(op.gas_position(arbs_with_tx(spark, sf), ["regime", "trigger"]))


def _level(tag: str, source: str, by: str) -> str:
    inner = concentration_sql(source, by, 20, False)
    cols = ", ".join(f"{c} AS {tag}_{c}" for c in ("n_members", "hhi_count", "top1_share", "top3_share", "n_for_90pct", "n_active"))
    return f"SELECT {by}, {cols} FROM ({inner})"


@query("contracts_vs_operators", with_parts(f"""
    , lc AS (SELECT pool, regime, sender AS member, count(*) AS n FROM ol GROUP BY ALL), lo AS (SELECT pool, regime, operator AS member, count(*) AS n FROM ol WHERE operator <> 'anon' GROUP BY ALL),
    cr AS (SELECT regime, operator FROM ol WHERE operator <> 'anon' GROUP BY 1, 2 HAVING count(DISTINCT pool) >= 2)
    SELECT * FROM (SELECT o.pool, o.regime, count(*) AS arbs, round(avg(CASE WHEN t.contracts >= 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS multi_share,
                          round(avg(CASE WHEN cr.operator IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS cross_share, round(avg(CASE WHEN o.via_public THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS public_share,
                          round(avg(CASE WHEN o.operator = 'anon' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS anon_share
                   FROM ol o LEFT JOIN ot t USING (operator) LEFT JOIN cr ON cr.regime = o.regime AND cr.operator = o.operator GROUP BY 1, 2)
    JOIN ({_level('c', 'lc', 'pool, regime')}) USING (pool, regime) LEFT JOIN ({_level('o', 'lo', 'pool, regime')}) USING (pool, regime)""", "ol", "ot"))
def contracts_vs_operators(spark, sf):
    labelled, operators = _labelled(spark, sf)
    return rounded(op.contracts_vs_operators(labelled, operators, ["pool", "regime"]))


@query("router_robustness", with_parts(f"""
    SELECT pool, regime, round({mean_if('via_public', 'true')}, 6) AS router_share_all, round({mean_if('via_public', CEX)}, 6) AS router_share_cex,
           {', '.join(f"round(quantile_cont(tau_ms::DOUBLE, {q}) FILTER ({CEX}{extra}) - {q}::DOUBLE * max({DT_SQL}), 6) AS q{int(q * 100)}_{tag}" for tag, extra in (('all', ''), ('bots', ' AND NOT via_public')) for q in (0.1, 0.5))},
           round({mean_if('k_blocks = 1', CEX)}, 6) AS p_first_all, round({mean_if('k_blocks = 1', CEX + ' AND NOT via_public')}, 6) AS p_first_bots FROM ol GROUP BY 1, 2""", "ol"))
def router_robustness(spark, sf):
    return rounded(op.router_robustness(_labelled(spark, sf)[0], ["pool", "regime"], interval_ms(), m.MAX_TAU_MS))


POINTS_SQL = f"""
    SELECT regime, operator, count(*) AS arbs, count(*) FILTER ({CEX}) AS n_cex, count(DISTINCT sender) AS contracts, count(DISTINCT tx_from) AS wallets,
           quantile_cont(tau_ms::DOUBLE, 0.1) FILTER ({CEX}) - 0.1::DOUBLE * max({DT_SQL}) AS ell_q10, quantile_cont(tau_ms::DOUBLE, 0.5) FILTER ({CEX}) - 0.5::DOUBLE * max({DT_SQL}) AS ell_q50,
           {mean_if('k_blocks = 1', CEX)} AS p_first, quantile_cont(gas_price_wei / 1e9::DOUBLE, 0.5) AS median_gas_gwei
    FROM ol WHERE operator <> 'anon' GROUP BY 1, 2 HAVING count(*) FILTER ({CEX}) >= 5"""
m.PARTS["pt"] = (("ol",), POINTS_SQL)


def _points(spark, sf):
    return op.operator_points(_labelled(spark, sf)[0], interval_ms(), m.MAX_TAU_MS, 5)


@query("operator_points", with_parts("SELECT regime, operator, arbs, n_cex, contracts, wallets, round(ell_q10, 6) AS ell_q10, round(ell_q50, 6) AS ell_q50, round(p_first, 6) AS p_first, round(median_gas_gwei, 6) AS median_gas_gwei FROM pt", "pt"))
def operator_points(spark, sf):
    return rounded(_points(spark, sf))


@query("operator_trajectories", with_parts("""
    SELECT operator, round(max(ell_q10) FILTER (regime = 'pre'), 6) AS pre, round(max(ell_q10) FILTER (regime = 'post'), 6) AS post, CAST(count(*) AS INTEGER) AS present FROM pt GROUP BY operator HAVING count(*) >= 2""", "pt"))
def operator_trajectories(spark, sf):
    return rounded(op.trajectories(_points(spark, sf), "operator", "regime", "ell_q10", ["pre", "post"], 2))


@query("operator_entry_exit", with_parts(f"""
    SELECT pool, count(*) FILTER (a >= {MIN_ARBS} AND b >= {MIN_ARBS}) AS stayers, count(*) FILTER (a < {MIN_ARBS} AND b >= {MIN_ARBS}) AS entrants,
           count(*) FILTER (a >= {MIN_ARBS} AND b < {MIN_ARBS}) AS exits, round(coalesce(sum(b) FILTER (a < {MIN_ARBS} AND b >= {MIN_ARBS}), 0) / nullif(sum(b), 0), 6) AS entrants_share
    FROM (SELECT pool, operator, count(*) FILTER (regime = 'pre') AS a, count(*) FILTER (regime = 'post') AS b FROM ol WHERE operator <> 'anon' GROUP BY 1, 2) GROUP BY pool""", "ol"))
def operator_entry_exit(spark, sf):
    from tideline.plans.response import entry_exit

    return rounded(entry_exit(_labelled(spark, sf)[0].filter("operator <> 'anon'"), "operator", ["pool"], MIN_ARBS))
