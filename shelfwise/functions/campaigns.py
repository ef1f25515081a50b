"""Campaign codes of a promotion: keyword themes plus mechanic rules, in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .core import col

# Code -> (label, keyword pattern).
CAMPAIGNS = {
    "RAMADHAN_LEBARAN": ("Ramadhan & Lebaran", r"ramadhan|ramadan|lebaran|idul\s*fitri|kurma|berkah|festive|biskuit\s*kaleng|kaleng|hampers|parcel|parsel"),
    "JSM_WEEKEND": ("JSM Weekend", r"jsm|jumat\s*sabtu\s*minggu|promo\s*weekend|akhir\s*pekan|weekend\s*promo"),
    "GAJIAN_PAYDAY": ("Payday / Gajian", r"gajian|payday|promo\s*gajian|super\s*hemat\s*gajian|awal\s*bulan|akhir\s*bulan"),
    "BACK_TO_SCHOOL": ("Back to School", r"back\s*to\s*school|kembali\s*ke\s*sekolah|bekal\s*sekolah|bekal\s*anak|tahun\s*ajaran\s*baru"),
    "BOGO": ("Buy 1 Get 1 / BOGO", r"b1g1|b2g1|beli\s*\d+\s*gratis\s*\d+|buy\s*\d+\s*get\s*\d+|gratis\s*1"),
    "CASHBACK_EWALLET": ("Cashback & E-Wallet", r"cashback|gopay|shopeepay|shopee\s*pay|ovo|dana|astrapay|astra\s*pay|linkaja|qris|e-wallet|ewallet"),
    "BUNDLE_TWIN": ("Bundle & Multi-pack", r"bundle|bundling|paket\s*hemat|twin\s*pack|multi\s*pack|2\s*lebih\s*hemat|beli\s*2\s*lebih\s*hemat"),
    "MEMBER_SPECIAL": ("Member Exclusive", r"member|khusus\s*member|poinku|indomaret\s*poinku|alfagift|myalfamart|point|loyalty"),
    "FLASH_SALE": ("Flash / Clearance", r"flash\s*sale|promo\s*kilat|cuci\s*gudang|clearance|diskon\s*kilat|harga\s*spesial"),
}


def campaign_codes(text: Column | str, mechanic: Column | str, cashback: Column | None = None,
                   buy: Column | str | None = None, bundle: Column | None = None) -> Column:
    """Array of matching codes. ``text`` is the joined name, title, description, gift, category and evidence."""
    kind = F.upper(F.coalesce(col(mechanic), F.lit("")))
    amount = F.coalesce(cashback, F.lit(0.0)) if cashback is not None else F.lit(0.0)
    bought = F.coalesce(col(buy), F.lit(0)) if buy is not None else F.lit(0)
    bundled = F.coalesce(bundle, F.lit(0)) if bundle is not None else F.lit(0)
    by_mechanic = {
        "BOGO": (kind == "BUY_X_GET_Y") | (bought > 0),
        "CASHBACK_EWALLET": (kind == "CASHBACK") | (amount > 0),
        "BUNDLE_TWIN": kind.isin("BUNDLE", "MULTIBUY") | (bundled > 1),
        "MEMBER_SPECIAL": kind == "MEMBER_PRICE",
    }
    corpus = F.coalesce(col(text), F.lit(""))
    flags = []
    for code, (_, words) in CAMPAIGNS.items():
        hit = corpus.rlike(rf"(?i)\b({words})\b")
        if code in by_mechanic:
            hit = by_mechanic[code] | hit
        flags.append(F.when(hit, F.lit(code)))
    return F.array_compact(F.array(*flags))


def campaign_labels(codes: Column) -> Column:
    table = F.create_map(*[F.lit(x) for code, (label, _) in CAMPAIGNS.items() for x in (code, label)])
    return F.transform(codes, lambda c: F.element_at(table, c))
