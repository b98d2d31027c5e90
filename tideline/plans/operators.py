"""Who trades: transactions, contracts, public routers, operators (connected contracts and wallets) and their profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tideline.operators.graph import connected_components
from tideline.operators.quantiles import Quantile, summarise
from tideline.operators.ranking import concentration, top_n
from tideline.plans.panel import when
from tideline.plans.response import is_trigger, market_triggered, share
from tideline.session import stored

# Labels of flow that belongs to no operator, and the prefixes of the two node kinds.
ANONYMOUS, PUBLIC = "anon", "public"
CONTRACT, WALLET = "c:", "e:"


def with_transactions(arbs: DataFrame, transactions: DataFrame) -> DataFrame:
    """Attaches the transaction of every arbitrage by (block, log_index); missing ones stay NULL."""
    return arbs.join(transactions, ["block", "log_index"], "left")


def transaction_coverage(arbs: DataFrame, by: list[str]) -> DataFrame:
    return arbs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), share(F.col("tx_from").isNotNull()).alias("coverage"))


def recover_attribute(rows: DataFrame, facts: DataFrame, keys: list[str], attribute: str) -> DataFrame:
    """Refills ``attribute`` of the keyed rows from the fact table: semi-join, one value per key, join back."""
    wanted = rows.select(*keys).distinct()
    found = facts.select(*keys, attribute).join(wanted, keys, "left_semi").groupBy(*keys).agg(F.min(attribute).alias(attribute))
    return rows.drop(attribute).join(found, keys, "left")


def wallet_pairs(arbs: DataFrame) -> DataFrame:
    return arbs.filter("tx_from IS NOT NULL").groupBy("sender", "tx_from").agg(F.count(F.lit(1)).alias("n"))


def contract_table(arbs: DataFrame, public_wallets: int, public_median: float, bounded: bool = False) -> DataFrame:
    """Per sender with known wallets: arbitrages, distinct wallets, median per wallet, top shares, pools, direct share,
    and whether it is a public router or rotates its wallets."""
    pairs = wallet_pairs(arbs)
    per = summarise(pairs, ["sender"], [F.count(F.lit(1)).alias("distinct_wallets"), F.sum("n").alias("arbs_with_tx")], [Quantile("median_per_wallet", F.col("n"), 0.5)], bounded)
    leaders = top_n(pairs, ["sender"], [F.col("n").desc(), F.col("tx_from")], 3)
    tops = leaders.groupBy("sender").agg(F.max(F.when(F.col("rank") == 1, F.col("n"))).alias("_top1"), F.sum("n").alias("_top3"))
    activity = arbs.groupBy("sender").agg(
        F.count(F.lit(1)).alias("arbs"), F.count_distinct("pool").alias("pools"),
        F.avg(F.when(F.lower("tx_to") == F.lower("sender"), 1.0).when(F.col("tx_to").isNotNull(), 0.0)).alias("direct_share"),
    )
    j = per.join(tops, "sender").join(activity, "sender")
    many = F.col("distinct_wallets") >= public_wallets
    public = many & (F.col("median_per_wallet") <= public_median)
    return j.select(
        "sender", "arbs", "arbs_with_tx", "distinct_wallets", "median_per_wallet", (F.col("_top1") / F.col("arbs_with_tx")).alias("top_wallet_share"),
        (F.col("_top3") / F.col("arbs_with_tx")).alias("top3_wallet_share"), "pools", "direct_share", public.alias("public"), (many & ~public).alias("wallet_rotation"),
    )


def with_operators(arbs: DataFrame, contracts: DataFrame, min_arbs: int) -> tuple[DataFrame, DataFrame]:
    """(arbs with operator and via_public, operator table).

    Components of the private contract-wallet graph are the operators. Flow through a public router belongs to the
    operator of its wallet if the wallet also uses a private contract, to the wallet itself if it sent at least
    ``min_arbs`` of it, and is anonymous otherwise. Public contracts, pairs and components are written on the
    way, so that the plans of both results stay short; write the first one before reading it several times."""
    public = stored(contracts.filter("public").select("sender", F.lit(True).alias("via_public")), "public")
    tagged = arbs.join(public, "sender", "left").withColumn("via_public", F.coalesce("via_public", F.lit(False)))
    private = stored(wallet_pairs(tagged.filter("NOT via_public")), "private")
    edges = private.select(F.concat(F.lit(CONTRACT), F.col("sender")).alias("a"), F.concat(F.lit(WALLET), F.col("tx_from")).alias("b"))
    parts = connected_components(edges, "a", "b")
    of_contract = parts.filter(F.col("member").startswith(CONTRACT)).select(F.substr("member", F.lit(3)).alias("sender"), F.col("component").alias("_by_contract"))
    of_wallet = parts.filter(F.col("member").startswith(WALLET)).select(F.substr("member", F.lit(3)).alias("tx_from"), F.col("component").alias("_by_wallet"))
    steady = tagged.filter("via_public AND tx_from IS NOT NULL").groupBy("tx_from").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_arbs)
    # One small label table per wallet, so the facts are joined once with it and once with the contract labels.
    wallets = of_wallet.join(steady, "tx_from", "full_outer").select(
        "tx_from", F.coalesce("_by_wallet", F.concat(F.lit(WALLET), F.col("tx_from"))).alias("_wallet_operator")
    )
    j = tagged.join(of_contract, "sender", "left").join(wallets, "tx_from", "left")
    own = F.coalesce("_by_contract", F.concat(F.lit(CONTRACT), F.col("sender")))
    operator = F.when(~F.col("via_public"), own).otherwise(F.coalesce("_wallet_operator", F.lit(ANONYMOUS)))
    labelled = j.withColumn("operator", operator).drop("_by_contract", "_wallet_operator")
    table = private.join(of_contract, "sender").groupBy(F.col("_by_contract").alias("operator")).agg(
        F.count_distinct("sender").alias("contracts"), F.count_distinct("tx_from").alias("wallets"), F.sum("n").alias("arbs")
    )
    return labelled, table


def member_concentration(arbs: DataFrame, by: list[str], member: str, active: int = 20) -> DataFrame:
    counts = arbs.groupBy(*by, member).agg(F.count(F.lit(1)).alias("n"))
    return concentration(counts, by, "n", active=active)


def contracts_vs_operators(arbs: DataFrame, operators: DataFrame, by: list[str], active: int = 20) -> DataFrame:
    """Concentration at both levels, and shares by multi-contract, cross-pool, public and anonymous flow."""
    named = arbs.filter(F.col("operator") != ANONYMOUS)
    level = lambda df, member, tag: member_concentration(df, by, member, active).select(
        *by, *[F.col(c).alias(f"{tag}_{c}") for c in ("n_members", "hhi_count", "top1_share", "top3_share", "n_for_90pct", "n_active")]
    )
    multi = operators.filter("contracts >= 2").select("operator", F.lit(1.0).alias("_multi"))
    pools = named.groupBy("regime", "operator").agg(F.count_distinct("pool").alias("_pools")).filter("_pools >= 2").select("regime", "operator", F.lit(1.0).alias("_cross"))
    counts = arbs.groupBy(*by, *([] if "regime" in by else ["regime"]), "operator").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if("via_public").alias("_public")
    )
    flagged = counts.join(multi, "operator", "left").join(pools, ["regime", "operator"], "left")
    weighted = lambda c: (F.sum(F.coalesce(c, F.lit(0.0)) * F.col("_n")) / F.sum("_n"))
    shares = flagged.groupBy(*by).agg(
        F.sum("_n").alias("arbs"), weighted(F.col("_multi")).alias("multi_share"), weighted(F.col("_cross")).alias("cross_share"),
        (F.sum("_public") / F.sum("_n")).alias("public_share"), weighted(F.when(F.col("operator") == ANONYMOUS, 1.0)).alias("anon_share"),
    )
    return shares.join(level(arbs, "sender", "c"), by).join(level(named, "operator", "o"), by, "left")


def flow_class() -> Column:
    persistent = F.col("operator").startswith(WALLET) | F.col("operator").startswith(CONTRACT)
    return F.when(~F.col("via_public"), "bot contracts").when(persistent, "router, persistent wallet").otherwise("router, one-off wallet")


def flow_profiles(arbs: DataFrame, max_tau_ms: int, bounded: bool = False) -> DataFrame:
    """Share, wallets, sizes, overshoot, trigger mix and speed of bot flow and the two kinds of router flow."""
    d = arbs.withColumn("flow", flow_class())
    cex = market_triggered(max_tau_ms)
    t = summarise(
        d, ["flow"],
        [F.count(F.lit(1)).alias("n"), F.count_distinct("tx_from").alias("wallets"), share(is_trigger("same_block")).alias("same_block_share"),
         share(is_trigger("cex")).alias("cex_share"), share(F.col("k_blocks") == 1, cex).alias("p_first")],
        [Quantile("median_size", F.col("volume_q"), 0.5), Quantile("median_overshoot", F.col("overshoot_bps"), 0.5), Quantile("median_tau", when(cex, "tau_ms"), 0.5)], bounded,
    )
    wallets = d.filter("tx_from IS NOT NULL").groupBy("flow", "tx_from").agg(F.count(F.lit(1)).alias("_n"))
    per_wallet = summarise(wallets, ["flow"], [], [Quantile("median_per_wallet", F.col("_n"), 0.5)], bounded)
    total = t.agg(F.sum("n").alias("_all"))
    return t.join(per_wallet, "flow", "left").crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("_all")).drop("_all")


def wallet_rotation(arbs: DataFrame, by: list[str], active: int = 20, bounded: bool = False) -> DataFrame:
    """Share of arbitrages by contracts with many wallets, wallets of the five largest, median wallets of active ones."""
    per = arbs.groupBy(*by, "sender").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("tx_from").alias("wallets"))
    t = summarise(
        per, by,
        [F.sum("n").alias("arbs"), F.count_if(F.col("n") >= active).alias("active_contracts"),
         (F.sum(F.when(F.col("wallets") >= 30, F.col("n")).otherwise(0)) / F.sum("n")).alias("share_ge30_wallets"),
         (F.sum(F.when(F.col("wallets") >= 5, F.col("n")).otherwise(0)) / F.sum("n")).alias("share_ge5_wallets")],
        [Quantile("median_wallets_active", when(F.col("n") >= active, "wallets"), 0.5)], bounded,
    )
    five = top_n(per, by, [F.col("n").desc(), F.col("sender")], 5)
    listed = five.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "wallets"))), lambda s: s["wallets"]).alias("_w"))
    return t.join(listed.select(*by, F.array_join("_w", " / ").alias("top5_wallets")), by)


def gas_position(arbs: DataFrame, by: list[str], bounded: bool = False) -> DataFrame:
    """Gas price, gas used, block position and cost against gain; cost in units of the native price column."""
    d = arbs.filter("gas_price_wei > 0").withColumn("_g", F.col("gas_price_wei") / 1e9)
    cost = F.col("_g") * F.col("gas_used") / 1e9 * F.col("native_price")
    d = d.withColumn("_cost", cost)
    t = summarise(
        d, by,
        [F.count(F.lit(1)).alias("n"), share(F.col("tx_index") == 0).alias("share_first"), share(F.col("tx_index") <= 2).alias("share_top3"),
         F.try_divide(F.sum("_cost"), F.sum("arb_loss")).alias("gas_over_gain")],
        [Quantile("gas_median", F.col("_g"), 0.5), Quantile("gas_p90", F.col("_g"), 0.9), Quantile("gas_used_median", F.col("gas_used"), 0.5),
         Quantile("tx_index_median", F.col("tx_index"), 0.5), Quantile("cost_median", F.col("_cost"), 0.5), Quantile("gain_median", F.col("arb_loss"), 0.5)], bounded,
    )
    high = d.join(t.select(*by, "gas_median"), by).groupBy(*by).agg(share(F.col("_g") > 1.5 * F.col("gas_median")).alias("share_above_1_5_median"))
    return t.join(high, by)


def router_robustness(arbs: DataFrame, by: list[str], dt_ms: Column, max_tau_ms: int, bounded: bool = False) -> DataFrame:
    """Latency intercepts and first-block shares of all market-triggered flow and of bot flow only."""
    cex = market_triggered(max_tau_ms)
    bots = cex & ~F.col("via_public")
    t = summarise(
        arbs.withColumn("_dt", dt_ms), by,
        [F.max("_dt").cast("double").alias("_dt"), share(F.col("via_public")).alias("router_share_all"), share(F.col("via_public"), cex).alias("router_share_cex"),
         share(F.col("k_blocks") == 1, cex).alias("p_first_all"), share(F.col("k_blocks") == 1, bots).alias("p_first_bots")],
        [Quantile(f"q{int(q * 100)}_{tag}", when(test, "tau_ms"), q) for tag, test in (("all", cex), ("bots", bots)) for q in (0.1, 0.5)], bounded,
    )
    net = [(F.col(f"q{int(q * 100)}_{tag}") - q * F.col("_dt")).alias(f"q{int(q * 100)}_{tag}") for tag in ("all", "bots") for q in (0.1, 0.5)]
    return t.select(*by, "router_share_all", "router_share_cex", *net, "p_first_all", "p_first_bots")


def operator_points(arbs: DataFrame, dt_ms: Column, max_tau_ms: int, min_cex: int, bounded: bool = False) -> DataFrame:
    """Operators with enough market-triggered arbitrages per regime: contracts, wallets, steady wallets, speed, gas."""
    named = arbs.filter(F.col("operator") != ANONYMOUS).withColumn("_dt", dt_ms)
    cex = market_triggered(max_tau_ms)
    keys = ["regime", "operator"]
    t = summarise(
        named, keys,
        [F.count(F.lit(1)).alias("arbs"), F.count_if(cex).alias("n_cex"), F.count_distinct("sender").alias("contracts"), F.count_distinct("tx_from").alias("wallets"),
         F.max("_dt").cast("double").alias("_dt"), share(F.col("k_blocks") == 1, cex).alias("p_first")],
        [Quantile("_q10", when(cex, "tau_ms"), 0.1), Quantile("_q50", when(cex, "tau_ms"), 0.5), Quantile("median_gas_gwei", F.col("gas_price_wei") / 1e9, 0.5)], bounded,
    ).filter(F.col("n_cex") >= min_cex)
    return t.select(
        *keys, "arbs", "n_cex", "contracts", "wallets", (F.col("_q10") - 0.1 * F.col("_dt")).alias("ell_q10"), (F.col("_q50") - 0.5 * F.col("_dt")).alias("ell_q50"),
        "p_first", "median_gas_gwei",
    )


def trajectories(points: DataFrame, member: str, regime: str, value: str, regimes: list[str], min_regimes: int) -> DataFrame:
    """One column per regime for members present in at least ``min_regimes`` of them."""
    wide = points.groupBy(member).pivot(regime, regimes).agg(F.max(value))
    present = sum((F.when(F.col(f"`{r}`").isNotNull(), 1).otherwise(0) for r in regimes), F.lit(0))
    return wide.withColumn("present", present).filter(F.col("present") >= min_regimes)
