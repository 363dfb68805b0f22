"""Identifiers: UUID text to bytes and back, and repeatable keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uuid_to_bin(text: Column) -> Column:
    return F.unhex(F.replace(text, F.lit("-"), F.lit("")))


def bin_to_uuid(value: Column) -> Column:
    return F.regexp_replace(
        F.lower(F.hex(value)), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"
    )


def stable_uuid(*parts: Column) -> Column:
    """A UUID-shaped key from the natural key, so a re-run gives the same id."""
    return bin_to_uuid(F.unhex(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))))


def key_hash(key: Column) -> Column:
    """Multiplicative hash of an integer key into 0..999, equal in any SQL engine."""
    return F.pmod(F.pmod(key, F.lit(1000003)) * F.lit(2654435761), F.lit(1000)).cast("int")


def in_train(key: Column, train_permille: int = 800) -> Column:
    """Repeatable split on a key: a row's side does not depend on partitioning."""
    return key_hash(key) < F.lit(train_permille)


PAIR_BITS = 20


def pair_key(player: Column, game: Column) -> Column:
    """One number for (player, game), without collisions: game ids are below 2 ** 20."""
    return F.shiftleft(player.cast("bigint"), PAIR_BITS).bitwiseOR(game.cast("bigint"))


def pair_of(key: Column) -> tuple[Column, Column]:
    """The player and the game of a ``pair_key``."""
    return F.shiftright(key, PAIR_BITS), key.bitwiseAND(F.lit((1 << PAIR_BITS) - 1)).cast("int")
