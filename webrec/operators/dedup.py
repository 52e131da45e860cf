"""De-duplication: first row per key, and greedy de-duplication over several
keys. Every form takes an explicit total order, so results do not depend on
how the work was split."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webrec.functions.common import filled, text
from webrec.functions.urls import url_netloc
from webrec.session import cut_lineage


def _key(key: Column | str) -> Column:
    return F.col(key) if isinstance(key, str) else key


def top_per_key(df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column], k: int) -> DataFrame:
    """First k rows per key in the given order.

    The rank filter sits right on the window, so Spark also applies it before
    the shuffle (partial group limit): each task sends at most k rows per key,
    and a key holding a third of all rows stays small on the receiving side.
    """
    w = Window.partitionBy(*[_key(x) for x in keys]).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def first_per_key(df: DataFrame, key: Column | str, order: Sequence[Column]) -> DataFrame:
    return top_per_key(df, [key], order, 1)


def dedup_keyed(df: DataFrame, key: Column, order: Sequence[Column], *, row_id: str = "id", keep_null_keys: bool = False) -> DataFrame:
    """First row per key. Rows without a key are dropped, or all kept when
    ``keep_null_keys``: they then group by their own id, so they spread evenly
    and never form one group."""
    if not keep_null_keys:
        return first_per_key(df.where(key.isNotNull()), key, order)
    own = F.when(key.isNull(), F.col(row_id))
    return top_per_key(df, [key, own], order, 1)


# -- key expressions ----------------------------------------------------------
def low(c: Column | str) -> Column:
    return F.lower(F.trim(text(c)))


def key_url_lower(url="url") -> Column:
    return low(url)


def key_host(website="website") -> Column:
    return url_netloc(website)


def key_host_or_identity(website="website", name="name", city="city", region="region") -> Column:
    return F.coalesce(url_netloc(website), F.concat_ws("|", low(name), low(city), low(region)))


def key_name_address_phone(name="name", address="address", phone="phone") -> Column:
    """Name required, null otherwise."""
    return F.when(low(name) != "", F.concat_ws("|", low(name), low(address), F.trim(text(phone))))


def key_name_city_state(name="name", city="city", state="state") -> Column:
    return F.when(F.length(low(name)) > 3, F.concat(low(name), F.lit("|"), low(city), F.lit("+"), low(state)))


def key_name_city(name="name", city="city") -> Column:
    return F.when(low(name) != "", F.concat_ws("_", low(name), low(city)))


def key_phone_or_name_city(phone="phone", name="name", city="city") -> Column:
    return F.when(
        low(name) != "",
        F.when(filled(F.trim(text(phone))), F.trim(text(phone))).otherwise(F.concat_ws("_", low(name), low(city))),
    )


def key_name_phone_site(name="name", phone="phone", website="website") -> Column:
    return F.concat_ws("|", low(name), F.regexp_replace(text(phone), r"[ \-()]", ""), low(website))


def key_geo(lat="latitude", lon="longitude", name="name") -> Column:
    """Coordinates at four decimals, else the name."""
    point = F.concat_ws(",", F.round(_key(lat), 4).cast("decimal(10,4)").cast("string"), F.round(_key(lon), 4).cast("decimal(10,4)").cast("string"))
    return F.when(_key(lat).isNotNull() & _key(lon).isNotNull(), point).when(low(name) != "", low(name))


# -- several keys -------------------------------------------------------------
def dedup_host_then_name(df: DataFrame, host: Column, name: Column, order: Sequence[Column], row_id: str = "id") -> DataFrame:
    """First row per host, then first per name among those. A row that later
    falls to its name still blocks its host, so two passes are exact."""
    by_host = dedup_keyed(df, host, order, row_id=row_id, keep_null_keys=True)
    return dedup_keyed(by_host, name, order, row_id=row_id, keep_null_keys=True)


def dedup_greedy(df: DataFrame, keys: Sequence[Column], rank: Column | str, row_id: str = "id", max_rounds: int = 10_000) -> DataFrame:
    """Keep a row iff no earlier *kept* row shares any of its keys.

    ``rank`` must be unique. Null keys match nothing. Each round, a live row
    that is first in all of its key groups is kept, and every live row sharing
    a key with a kept row is dropped. Only (id, rank, keys) travel; key groups
    meet as one pre-aggregated row per key, never as pairs. Each round writes a
    reliable checkpoint, so a lost executor costs no more than that round.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    live = df.select(
        F.col(row_id).alias("_id"), _key(rank).alias("_rank"), *[k.cast("string").alias(n) for k, n in zip(keys, names)]
    )

    def own(n: str) -> Column:
        # a row without this key gets a value of its own that matches nothing
        return F.coalesce(F.col(n), F.concat(F.lit("\u0000"), F.col("_id").cast("string")))

    kept: list[DataFrame] = []
    for _ in range(max_rounds):
        marked = live
        for n in names:
            firsts = live.where(F.col(n).isNotNull()).groupBy(F.col(n).alias("_j")).agg(F.min("_rank").alias(f"{n}_min"))
            marked = marked.withColumn("_j", own(n)).join(firsts, "_j", "left").drop("_j")
        is_first = reduce(lambda a, b: a & b, [F.col(n).isNull() | (F.col("_rank") == F.col(f"{n}_min")) for n in names])
        marked = cut_lineage(marked.select("_id", "_rank", *names, is_first.alias("_keep")))
        winners = marked.where("_keep")
        kept.append(winners.select("_id"))
        rest = marked.where("not _keep").drop("_keep")
        for n in names:
            # a key has at most one kept row, so this side is unique per key
            taken = winners.where(F.col(n).isNotNull()).select(F.col(n).alias("_j"))
            rest = rest.withColumn("_j", own(n)).join(taken, "_j", "left_anti").drop("_j")
        live = cut_lineage(rest.select("_id", "_rank", *names))
        if live.isEmpty():
            break
    else:
        raise RuntimeError(f"greedy de-duplication did not settle in {max_rounds} rounds")
    ids = reduce(DataFrame.unionAll, kept)
    return df.join(ids.withColumnRenamed("_id", row_id), row_id, "left_semi")


def greedy_keys_name_or_site(name="name", website="website") -> list[Column]:
    def k(c):
        return F.nullif(low(c), F.lit(""))

    return [k(name), k(website)]


def greedy_keys_contact_or_name(phone="phone", email="email", name="name") -> list[Column]:
    """A blank phone and e-mail pair is a key like any other."""
    return [F.concat_ws("|", text(phone), text(email)), F.substring(F.lower(text(name)), 1, 50)]


def dedup_phone_candidates(candidates: DataFrame, page: str = "page_id", *carry: str) -> DataFrame:
    """Per page and phone the row of highest confidence, the first such one.
    An aggregate, so repeated mentions are combined before the shuffle."""
    cols = carry or tuple(c for c in candidates.columns if c not in (page, "phone"))
    best = F.min_by(F.struct(*cols), F.struct(-F.col("confidence"), F.col("pos")))
    return candidates.groupBy(page, "phone").agg(best.alias("_b")).select(page, "phone", "_b.*")
