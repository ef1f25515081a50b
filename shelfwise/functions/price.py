"""Pack economics: effective price, price per 100 g, gap."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..config import CONDITIONAL_MECHANICS
from .core import col, instant, positive, round_half_up


def regular_pack_price(regular="regular_price", promo="promo_price", discount="discount_percentage") -> Column:
    """Shelf price before the offer: stated, else backed out of the promo price and the discount."""
    reg, pro, dis = col(regular), col(promo), col(discount)
    base = F.coalesce(reg, F.when((dis > 0) & (dis < 100), pro / (F.lit(1.0) - dis / 100.0)))
    return positive(round_half_up(base, 2))


def effective_pack_price(
    regular="regular_price", promo="promo_price", discount="discount_percentage",
    mechanic="promotion_type", buy="buy_quantity", free="free_quantity",
) -> Column:
    """What one pack costs under the offer; buy-x-get-y spreads the price over the free packs."""
    reg, pro, dis = col(regular), col(promo), col(discount)
    multi = F.coalesce(col(mechanic), F.lit("DISCOUNT")) == "BUY_X_GET_Y"
    base = F.coalesce(pro, F.when(dis > 0, reg * (F.lit(1.0) - dis / 100.0)), F.when(multi, reg))
    paid, given = col(buy).cast("double"), col(free).cast("double")
    share = F.when(multi & (paid > 0) & (given != 0), paid / (paid + given)).otherwise(F.lit(1.0))
    return positive(round_half_up(base * share, 2))


def per_100g(price: Column | str, grams: Column | str) -> Column:
    return round_half_up(positive(col(price)) / positive(col(grams)) * 100.0, 2)


def gap_pct(competitor: Column | str, own: Column | str) -> Column:
    c, o = col(competitor), col(own)
    return round_half_up((c - o) / positive(o) * 100.0, 1)


def stated_or_derived_discount(discount: Column | str, regular: Column | str, promo: Column | str) -> Column:
    reg, pro = col(regular), col(promo)
    derived = F.when((reg > 0) & (pro > 0) & (reg > pro), round_half_up((F.lit(1.0) - pro / reg) * 100.0, 1))
    return F.coalesce(col(discount), derived)


def comparable_offer(
    mechanic="promotion_type", currency="currency",
    min_amount="minimum_purchase_amount", min_quantity="minimum_purchase_quantity",
) -> Column:
    """Unconditional rupiah offers only; a minimum quantity is fine for buy-x-get-y."""
    kind = col(mechanic)
    return (
        (F.coalesce(col(currency), F.lit("IDR")) == "IDR")
        & ~F.coalesce(kind.isin(*CONDITIONAL_MECHANICS), F.lit(False))
        & (F.coalesce(col(min_amount), F.lit(0.0)) == 0)
        & ((F.coalesce(col(min_quantity), F.lit(0)) == 0) | F.coalesce(kind == "BUY_X_GET_Y", F.lit(False)))
    )


def own_promo_active(as_of, promo="promo_price", kind="promo_type", buy="buy_quantity", free="free_quantity",
                     starts="promo_start_date", ends="promo_end_date") -> Column:
    now = instant(as_of)
    bundle = (col(kind) == "BUY_X_GET_Y") & (col(buy) > 0) & (col(free) > 0)
    return (
        (col(promo).isNotNull() | F.coalesce(bundle, F.lit(False)))
        & (col(starts).isNull() | (col(starts) <= now))
        & (col(ends).isNull() | (col(ends) >= now))
    )
