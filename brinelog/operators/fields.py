"""Weather and current fields by the hour: joins of wind and current, and the nearest hour in either direction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import windows


def joined_fields(wind: DataFrame, current: DataFrame) -> DataFrame:
    return wind.join(current, "hour", "left")


def nearest_hour(probes: DataFrame, fields: DataFrame, within: int = 24) -> DataFrame:
    """Each probe (probe_id, t in epoch seconds) with the field of the nearest hour, the earlier of two; null beyond `within` hours.

    Which hours with a field lie next before and after depends on the probe's own hour alone, so they are looked up once for
    each hour that has probes, and the probes join that short table by their hour."""
    bucket = F.floor(F.col("t") / 3600).cast("long")
    around = probes.select(bucket.alias("bucket")).distinct().withColumn("hour", F.explode(F.sequence(F.col("bucket") - within, F.col("bucket") + 1 + within)))
    side = lambda f, when: f(F.when(when, F.struct(*fields.columns)), F.when(when, F.col("hour")))
    ends = around.join(fields, "hour").groupBy("bucket").agg(side(F.max_by, F.col("hour") <= F.col("bucket")).alias("back"), side(F.min_by, F.col("hour") > F.col("bucket")).alias("ahead"))
    met = probes.withColumn("bucket", bucket).join(ends, "bucket", "left")
    earlier = F.col("ahead").isNull() | (F.col("t") - F.col("back.hour") * 3600 <= F.col("ahead.hour") * 3600 - F.col("t"))
    return met.withColumn("f", F.when(F.col("back").isNotNull() & earlier, F.col("back")).otherwise(F.col("ahead"))).select(*probes.columns, "f.*")


# fixed values: what stands in where no field is known
DEFAULTS = {"wind": 5.0, "wind_from": 180.0, "current": 0.3, "current_to": 90.0}


def cache_key(lat, lon, moment):
    """Where and when a field is the same: hundredths of a degree and the hour."""
    return F.format_string("metocean:%.2f:%.2f:%s", lat, lon, F.date_format(moment, "yyyyMMdd_HH"))


def sampled(probes: DataFrame, fields: DataFrame, point: DataFrame | None = None, within: int = 24) -> DataFrame:
    """Each probe (probe_id, t) with the nearest hour's fields; a field that is missing there comes from the probe's own point
    sample (probe_id and the fields), else from the defaults. `source` says where each probe's values are from."""
    names = list(DEFAULTS)
    series = nearest_hour(probes, fields.select("hour", *names), within)
    own = point.select("probe_id", *[F.col(c).alias(f"point_{c}") for c in names]) if point is not None else probes.select("probe_id", *[F.lit(None).cast("double").alias(f"point_{c}") for c in names])
    met = series.join(own, "probe_id", "left")
    values = {c: F.coalesce(F.col(c), F.col(f"point_{c}"), F.lit(DEFAULTS[c])) for c in names}
    source = F.when(F.col("hour").isNotNull(), "series").when(F.coalesce(*[F.col(f"point_{c}") for c in names]).isNotNull(), "point").otherwise("default")
    return met.select(*probes.columns, "hour", *[v.alias(c) for c, v in values.items()], source.alias("source"), F.concat_ws(",", *[F.when(F.col(c).isNull(), F.lit(c)) for c in names]).alias("filled"))


def newest(store: DataFrame, key: str = "key", at: str = "fetched_at") -> DataFrame:
    """The last written row of each key."""
    rest = [c for c in store.columns if c != key]
    return store.groupBy(key).agg(F.max_by(F.struct(*rest), at).alias("v")).select(key, "v.*")


def to_ask(wanted: DataFrame, store: DataFrame, ttl: float = 21600.0) -> DataFrame:
    """Of the wanted (key, t) those that the store (key, fetched_at, ...) has no value for that is younger than `ttl` seconds: each once."""
    fresh = newest(store).select("key", "fetched_at")
    met = wanted.select("key", "t").join(fresh, "key", "left")
    return met.where(F.col("fetched_at").isNull() | (F.col("t") >= F.col("fetched_at") + ttl)).groupBy("key").agg(F.min("t").alias("t"))


def served(requests: DataFrame, ttl: float = 21600.0, open_s: float = 300.0) -> DataFrame:
    """What each request (request_id, service, key, t, ok, value) was answered with, had it gone through a store with expiry and a
    breaker: request_id, t, state, hit, source, value, age_s.

    An answer stands for `ttl` seconds, whatever it was. A request that no answer stands for is asked, unless the service failed
    less than `open_s` seconds before: the breaker is then open and the default stands in. The first request after that is a trial:
    if it fails, the breaker opens again. ok says whether the service would have answered, value with what.

    Which requests aren't answered from the store depends on their key alone, and which failures open the breaker on the failures
    alone; both are folds of their own, and all else meets by windows of time."""
    rows = requests.select(F.col("request_id").alias("id"), "service", "key", F.col("t").cast("double").alias("t"), "ok", "value")
    stands = windows(rows, ttl).select("id", "since", "opens")
    known = rows.join(stands, "id")
    asked = known.where("opens").select("id", "service", "key", "t", "ok", "value")
    failing = windows(asked.where("NOT ok").select(F.col("service").alias("key"), "id", "t"), open_s).where("opens")
    bucket = lambda t: F.floor(t / open_s)
    opened = failing.select(F.col("key").alias("o_service"), F.col("id").alias("o_id"), F.col("t").alias("opened"), F.explode(F.array(bucket(F.col("t")), bucket(F.col("t")) + 1)).alias("o_bucket"))
    after = (F.col("t") > F.col("opened")) | ((F.col("t") == F.col("opened")) & (F.col("id") > F.col("o_id")))
    within = (F.col("service").cast("string") == F.col("o_service")) & (F.col("bucket") == F.col("o_bucket")) & after & (F.col("t") < F.col("opened") + open_s)
    broken = asked.withColumn("bucket", bucket(F.col("t"))).join(opened, within, "left_semi").select("id", F.lit(True).alias("broken"))
    state = F.when(F.col("broken"), "open").otherwise("closed")
    answer = F.when(F.col("broken").isNull() & F.col("ok"), "fetched").otherwise("default")
    fills = asked.join(broken, "id", "left").select(F.col("key").alias("f_key"), F.col("t").alias("filled"), state.alias("state"), answer.alias("source"), F.when(answer == "fetched", F.col("value")).alias("value"))
    told = known.drop("value").join(fills, (F.col("key") == F.col("f_key")) & (F.col("since") == F.col("filled")))
    return told.select(F.col("id").alias("request_id"), "t", "state", (~F.col("opens")).alias("hit"), "source", "value", (F.col("t") - F.col("since")).alias("age_s"))
