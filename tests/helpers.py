import datetime as dt

from gridpulse import schema as S

BASE_TS = dt.datetime(2024, 6, 9, 10, 0, 0)


def complaint(key, lat=40.7, lon=-73.9, borough="QUEENS", ctype="Noise - Residential", created=BASE_TS, **extra):
    row = {c: None for c in S.COMPLAINT_SCHEMA.fieldNames()}
    row.update(
        unique_key=str(key), latitude=lat, longitude=lon, borough=borough, complaint_type=ctype,
        created_date=created, source="test", ingested_at=BASE_TS,
    )
    row.update(extra)
    return row


def complaints_df(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in S.COMPLAINT_SCHEMA.fieldNames()) for r in rows], S.COMPLAINT_SCHEMA)


def message(key="1", created="2024-01-05T10:00:00.000", lat="40.5", lon="-74.1", ctype="Noise - Residential", **extra):
    row = {c: None for c in S.MESSAGE_SCHEMA.fieldNames()}
    row.update(unique_key=key, created_date=created, latitude=lat, longitude=lon, complaint_type=ctype)
    row.update(extra)
    return row


def messages_df(spark, rows, meta=True):
    from pyspark.sql import types as T

    fields = list(S.MESSAGE_SCHEMA.fields)
    if meta:
        fields = [
            T.StructField("msg_offset", T.LongType()),
            T.StructField("partition_id", T.IntegerType()),
            T.StructField("msg_ts", T.TimestampNTZType()),
        ] + fields
    schema = T.StructType(fields)
    data = []
    for i, r in enumerate(rows):
        base = {"msg_offset": i, "partition_id": 0, "msg_ts": BASE_TS + dt.timedelta(seconds=i)}
        base.update(r)
        data.append(tuple(base.get(f.name) for f in fields))
    return spark.createDataFrame(data, schema)
