"""Identities, fingerprints and ranks as column expressions."""

import hashlib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

DOMAIN = "millrace/document/v1"
RANK_DOMAIN = "millrace/rank/v1"


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def _length8(c: Column) -> Column:
    """Byte length as eight big-endian bytes."""
    return F.unhex(F.lpad(F.hex(F.octet_length(c).cast("long")), 16, "0"))


def fingerprint(c: Column, domain: str = DOMAIN) -> Column:
    """sha256(domain, NUL, length, bytes): no two domains or splits of bytes collide."""
    return F.sha2(F.concat(F.encode(F.lit(domain), "UTF-8"), F.unhex(F.lit("00")), _length8(c), F.encode(c, "UTF-8")), 256)


def rank(seed: int, stage: str, source: Column, print_: Column) -> Column:
    """A place in the order of (seed, stage, source) that input order doesn't change."""
    return F.sha2(F.concat_ws("\x1f", F.lit(RANK_DOMAIN), F.lit(str(seed)), F.lit(stage), source, print_), 256)


def holdout(c: Column, share_of: tuple[int, int], seed: str = "holdout") -> Column:
    """True for about val / (train + val) of all texts, by integers only."""
    train, val = share_of
    h = F.conv(F.left(F.sha2(F.concat(F.lit(seed + "\x1f"), c), 256), F.lit(15)), 16, 10).cast("decimal(38,0)")
    return h * F.lit(train + val).cast("decimal(10,0)") < F.lit(val).cast("decimal(10,0)") * F.lit(1 << 60).cast("decimal(20,0)")


def tail_key(c: Column, most: int = 3000) -> Column:
    return F.sha1(F.right(c, F.lit(most)))


def short_id(prefix: str, *parts: Column, length: int = 10) -> Column:
    return F.concat(F.lit(prefix + "_"), F.left(F.md5(F.concat_ws("||", F.lit(prefix), *parts)), F.lit(length)))


def _mapped(c: Column, f) -> Column:
    """An Arrow UDF over strings; null stays null."""

    def go(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else f(v))

    return F.pandas_udf(go, StringType())(c)


def blake2b_rank(c: Column) -> Column:
    """Personalised BLAKE2b-128 of a string, in hex."""
    return _mapped(c, lambda v: hashlib.blake2b(v.encode(), digest_size=16, person=b"millrace-rank-v1").hexdigest())


def nfc_folded(c: Column) -> Column:
    """NFC, case-folded, white space squeezed."""
    return _mapped(c, lambda v: " ".join(unicodedata.normalize("NFC", v).casefold().split()))


def set_fingerprint(ids: Column) -> Column:
    """One hash for a set of ids, whatever their order: sha256 of count and sorted ids."""
    every = F.sort_array(F.collect_list(ids.cast("string")))
    return F.sha2(F.concat_ws("\x1f", F.size(every).cast("string"), F.array_join(every, "\x1f")), 256)
