"""Charges, fills, order sizes and expected edges as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom import constants as C


def by_product(product: Column, rates: dict) -> Column:
    """The rate of a product; null for an unknown one."""
    out = F
    for name, rate in rates.items():
        out = out.when(product == name, F.lit(float(rate)))
    return out


def brokerage(product: Column, value: Column, broker: Column) -> Column:
    flat_or_rate = F.least(F.lit(C.ZERODHA_MAX), F.lit(C.ZERODHA_RATE) * value)
    banded = F.greatest(F.lit(C.GROWW_MIN), F.least(F.lit(C.GROWW_MAX), F.lit(C.GROWW_RATE) * value))
    return (F.when(product == "option", F.lit(C.OPTION_BROKERAGE))
            .when(broker == "zerodha", F.when(product == "delivery", F.lit(0.0)).otherwise(flat_or_rate))
            .otherwise(banded))


def depository(product: Column, value: Column, broker: Column) -> Column:
    """The fixed charge for taking shares out of the depository, on delivery sells only."""
    return (F.when(product != "delivery", F.lit(0.0))
            .when(broker == "zerodha", F.lit(C.ZERODHA_DEPOSITORY))
            .when(value < C.GROWW_DEPOSITORY_FROM, F.lit(0.0))
            .otherwise(F.lit(C.GROWW_DEPOSITORY * (1 + C.GST))))


def charges(side: Column, product: Column, value: Column, broker: Column) -> dict[str, Column]:
    """Every charge on one executed order, and their total."""
    buy = F.lower(side) == "buy"
    fee = brokerage(product, value, broker)
    tax = value * F.when(buy, by_product(product, {k: v[0] for k, v in C.TRANSACTION_TAX.items()})).otherwise(
        by_product(product, {k: v[1] for k, v in C.TRANSACTION_TAX.items()}))
    exchange = value * by_product(product, C.EXCHANGE_FEE)
    regulator = value * F.lit(C.REGULATOR_FEE)
    stamp = F.when(buy, value * by_product(product, C.STAMP_ON_BUY)).otherwise(F.lit(0.0))
    gst = F.lit(C.GST) * (fee + exchange + regulator)
    held = F.when(buy, F.lit(0.0)).otherwise(depository(product, value, broker))
    parts = {"brokerage": fee, "transaction_tax": tax, "exchange_fee": exchange, "regulator_fee": regulator,
             "stamp": stamp, "gst": gst, "depository": held}
    total = fee + tax + exchange + regulator + stamp + gst + held
    return {**parts, "total": total}


def total_charge(side: str, product: Column | str, value: Column, broker: Column | str = "zerodha") -> Column:
    """The sum of `charges` for one side: everything in proportion to the value in one rate, plus the fixed parts."""
    product = F.lit(product) if isinstance(product, str) else product
    broker = F.lit(broker) if isinstance(broker, str) else broker
    buying = side == "buy"
    rates = {p: C.TRANSACTION_TAX[p][0 if buying else 1] + (C.STAMP_ON_BUY[p] if buying else 0.0)
             + (1 + C.GST) * (C.EXCHANGE_FEE[p] + C.REGULATOR_FEE) for p in C.EXCHANGE_FEE}
    out = value * by_product(product, rates) + (1 + C.GST) * brokerage(product, value, broker)
    return out if buying else out + depository(product, value, broker)


def buy_terms(product: Column, broker: Column) -> dict[str, Column]:
    """What buy charges are made of: `rate` of the value, and a brokerage of `fee_rate` between `low` and `high`."""
    rates = {p: C.TRANSACTION_TAX[p][0] + C.STAMP_ON_BUY[p] + (1 + C.GST) * (C.EXCHANGE_FEE[p] + C.REGULATOR_FEE) for p in C.EXCHANGE_FEE}
    option, free = product == "option", (broker == "zerodha") & (product == "delivery")

    def term(groww: float, zerodha: float, of_option: float) -> Column:
        return F.when(option, of_option).when(free, 0.0).when(broker == "zerodha", zerodha).otherwise(groww)

    return {"rate": by_product(product, rates), "fee_rate": term(C.GROWW_RATE, C.ZERODHA_RATE, 0.0),
            "low": term(C.GROWW_MIN, 0.0, C.OPTION_BROKERAGE), "high": term(C.GROWW_MAX, C.ZERODHA_MAX, C.OPTION_BROKERAGE)}


def fill_price(price: Column, side: Column, bps: Column | float) -> Column:
    """Pay up when buying, receive less when selling."""
    bps = F.lit(bps) if isinstance(bps, (int, float)) else bps
    return F.when(F.lower(side) == "buy", price * (1 + bps / 1e4)).otherwise(price * (1 - bps / 1e4))


def round_trip_cost(value: Column, product: Column | str = "delivery") -> Column:
    """Charges in and out plus slippage both ways, as a fraction of the ticket."""
    both = total_charge("buy", product, value) + total_charge("sell", product, value)
    return F.when(value <= 0, F.lit(1.0)).otherwise(
        F.try_divide(both, value) + 2 * C.STOCK_SLIPPAGE_BPS / 1e4)


def exit_cost(value: Column, product: Column | str = "delivery") -> Column:
    return F.when(value <= 0, F.lit(1.0)).otherwise(
        F.try_divide(total_charge("sell", product, value), value) + C.STOCK_SLIPPAGE_BPS / 1e4)


def expected_gross(rank: Column) -> Column:
    """Excess return a model rank stands for over the horizon, symmetric about the median."""
    return F.lit(C.TOP_EXCESS) * (rank - 0.5) / 0.5


def edge_per_day(rank: Column, value: Column) -> Column:
    return (expected_gross(rank) - round_trip_cost(value)) / C.EDGE_HORIZON


def clears_margin(rank: Column, value: Column) -> Column:
    cost = round_trip_cost(value)
    return expected_gross(rank) - cost >= C.EDGE_MARGIN * cost


def whole(money: Column, each: Column) -> Column:
    """How many whole times `each` goes into `money`; nothing is free, so a zero price buys none."""
    times = F.try_divide(money, each)
    return F.coalesce(F.when(times.isNotNull(), F.floor(F.least(times, F.lit(1e15)))), F.lit(0))


def buy_cost(value: Column, terms: dict[str, Column]) -> Column:
    """A buy's value and all its charges, from `buy_terms`."""
    fee = F.greatest(terms["low"], F.least(terms["high"], terms["fee_rate"] * value))
    return value + value * terms["rate"] + (1 + C.GST) * fee


def lots_cash_covers(cash: Column, fill: Column, lot: Column, terms: dict[str, Column]) -> Column:
    """Most lots whose value and buy charges `cash` covers, up to rounding.

    Buy charges are piecewise linear in the value: the dearer of a least and a usual fee, which is the cheaper of a rate and a
    highest fee. So the value covered is the lesser of what one and the greater of what the others leave.
    """
    linear, gst = 1 + terms["rate"], 1 + C.GST
    usual = F.greatest(cash / (linear + gst * terms["fee_rate"]), (cash - gst * terms["high"]) / linear)
    return whole(F.least((cash - gst * terms["low"]) / linear, usual), fill * lot)


def whole_units(covered: Column, budget: Column, cash: Column, fill: Column, lot: Column, terms: dict[str, Column]) -> Column:
    """Units in whole lots within the budget and, charges included, the cash.

    `covered` comes from `lots_cash_covers`; trying the lot above and the lot itself absorbs its rounding.
    """
    def pays(lots: Column) -> Column:
        return buy_cost(lots * lot * fill, terms) <= cash

    lots = F.when(pays(covered + 1), covered + 1).when(pays(covered), covered).otherwise(covered - 1)
    wanted = whole(F.least(budget, cash), fill * lot)
    return (F.greatest(F.least(wanted, lots), F.lit(0)) * lot).cast("bigint")
