"""European call values as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom import constants as C

# --- fixed values: rational fit of the normal distribution's tail (Hart 1968, as given by West 2005) ---
HART_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871,
            221.213596169931, 220.206867912376)
HART_BOTTOM = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674,
               637.333633378831, 793.826512519948, 440.413735824752)
HART_SPLIT, HART_SCALE = 7.07106781186547, 2.506628274631
# Beyond the split: 1/(a + 1/(a + 2/(a + 3/(a + 4/(a + 0.65))))), multiplied out.
FAR_TOP = (1.0, 0.65, 9.0, 3.25, 8.0)
FAR_BOTTOM = (1.0, 0.65, 10.0, 3.9, 15.0, 1.95)


def _horner(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function, good to about 1e-15. Pass a plain column: it is named often."""
    a = F.abs(x)
    near = a < HART_SPLIT
    top = F.when(near, _horner(a, HART_TOP)).otherwise(_horner(a, FAR_TOP))
    bottom = F.when(near, _horner(a, HART_BOTTOM)).otherwise(HART_SCALE * _horner(a, FAR_BOTTOM))
    tail = F.when(a > 37, F.lit(0.0)).otherwise(F.exp(-a * a / 2) * top / bottom)
    return F.when(x > 0, 1 - tail).otherwise(tail)


def price_calls(df: DataFrame, spot: str = "spot", strike: str = "strike", years: str = "years",
                vol: str = "vol", name: str = "value", rate: float = C.RATE) -> DataFrame:
    """Adds the Black-Scholes call value; intrinsic value once expired.

    The vol floor guards the denominator only. Both distribution values come from one small array, so the
    polynomial is compiled once and the stage's code stays within what the JVM optimises.
    """
    s, k, t, v = (F.col(c) for c in (spot, strike, years, vol))
    steps = (df.withColumn("_spread", F.greatest(v, F.lit(1e-4)) * F.sqrt(F.greatest(t, F.lit(0.0))))
             .withColumn("_d1", F.try_divide(F.ln(s / k) + (rate + 0.5 * v * v) * t, F.col("_spread")))
             .withColumn("_n", F.transform(F.array("_d1", F.col("_d1") - F.col("_spread")), normal_cdf)))
    alive = s * F.get("_n", F.lit(0)) - k * F.exp(-rate * t) * F.get("_n", F.lit(1))
    return (steps.withColumn(name, F.when(t <= 0, F.greatest(s - k, F.lit(0.0))).otherwise(alive))
            .drop("_spread", "_d1", "_n"))


def price_premiums(df: DataFrame, spot: str = "spot", strike: str = "strike", days_left: str = "days_left",
                   realised_vol: str = "realised_vol", name: str = "premium") -> DataFrame:
    """Adds the premium of calls `days_left` from expiry, at realised volatility plus the usual premium."""
    return price_calls(
        df.withColumn("_years", F.greatest(F.col(days_left), F.lit(0)) / 365.0)
        .withColumn("_vol", F.col(realised_vol) * C.VOL_PREMIUM),
        spot, strike, "_years", "_vol", name).drop("_years", "_vol")


def atm_strike(spot: Column) -> Column:
    """Nearest listed strike, halves to even."""
    return F.bround(spot / C.STRIKE_STEP) * C.STRIKE_STEP
