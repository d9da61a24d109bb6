"""Explicit schemas: a key that no object has reads as a typed null, so nothing is ever inferred.

Fixed values: the fields of the objects and the columns of both version tables, with their types and in their order.
"""

from __future__ import annotations

from pyspark.sql import types as T

STRING, INT, LONG, DOUBLE, BOOLEAN, TIMESTAMP = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(*f) for f in fields])


PROPOSAL = _struct(
    ("id", STRING),
    ("ipfs", STRING),
    ("title", STRING),
    ("body", STRING),
    ("discussion", STRING),
    ("state", STRING),
    ("type", STRING),
    ("start", LONG),
    ("end", LONG),
    ("created", LONG),
    ("author", STRING),
    ("quorum", DOUBLE),
    ("scores", T.ArrayType(DOUBLE)),
    ("scores_total", DOUBLE),
    ("votes", LONG),
    ("choices", T.ArrayType(STRING)),
    ("link", STRING),
    ("space", _struct(("id", STRING), ("name", STRING))),
)

POST = _struct(
    ("id", LONG),
    ("post_number", INT),
    ("username", STRING),
    ("cooked", STRING),
    ("created_at", STRING),
    ("updated_at", STRING),
    ("reply_count", INT),
)

TOPIC = _struct(
    ("id", LONG),
    ("title", STRING),
    ("slug", STRING),
    ("post_stream", _struct(("posts", T.ArrayType(POST)))),
)

PROPOSAL_VERSIONS = _struct(
    ("proposal_id", STRING),
    ("protocol_name", STRING),
    ("space_id", STRING),
    ("source", STRING),
    ("record_hash", STRING),
    ("content_hash", STRING),
    ("title", STRING),
    ("body", STRING),
    ("discussion_url", STRING),
    ("proposal_state", STRING),
    ("proposal_type", STRING),
    ("author", STRING),
    ("ipfs_cid", STRING),
    ("link", STRING),
    ("quorum", DOUBLE),
    ("scores_total", DOUBLE),
    ("vote_count", LONG),
    ("choices", T.ArrayType(STRING)),
    ("scores", T.ArrayType(DOUBLE)),
    ("voting_start", TIMESTAMP),
    ("voting_end", TIMESTAMP),
    ("proposal_created", TIMESTAMP),
    ("source_key", STRING),
    ("observed_at", TIMESTAMP),
    ("valid_from", TIMESTAMP),
    ("valid_to", TIMESTAMP),
    ("is_current", BOOLEAN),
)

FORUM_POSTS = _struct(
    ("forum_host", STRING),
    ("protocol_name", STRING),
    ("topic_id", LONG),
    ("post_id", LONG),
    ("post_number", INT),
    ("record_hash", STRING),
    ("content_hash", STRING),
    ("topic_title", STRING),
    ("topic_slug", STRING),
    ("username", STRING),
    ("body_html", STRING),
    ("body_text", STRING),
    ("post_created_at", TIMESTAMP),
    ("post_updated_at", TIMESTAMP),
    ("reply_count", INT),
    ("source_key", STRING),
    ("observed_at", TIMESTAMP),
    ("valid_from", TIMESTAMP),
    ("valid_to", TIMESTAMP),
    ("is_current", BOOLEAN),
)
