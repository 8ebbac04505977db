"""Checks of addresses and of messages as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The results of a check of an address.
CATEGORIES = ("ok", "redirect-domain-change", "client-error", "server-error", "timeout", "network-error")
#: Bytes of one text of a message, and tokens of an answer.
MAX_BYTES, MAX_TOKENS = 50 * 1024, 32_768
BLOCK = "struct<type: string, text: string, source_type: string, data: string>"


def url_category(status: Column, requested: Column, final: Column, error: Column) -> Column:
    """The category of a response (status, hosts asked for and reached) or of an error (timeout or another)."""
    moved = (F.coalesce(requested, F.lit("")) != "") & (F.coalesce(final, F.lit("")) != "") & (requested != final)
    got = F.when(status.between(200, 299), F.when(moved, CATEGORIES[1]).otherwise(CATEGORIES[0])).when(status.between(400, 499), CATEGORIES[2]).otherwise(CATEGORIES[3])
    return F.when(error == "timeout", CATEGORIES[4]).when(error.isNotNull(), CATEGORIES[5]).otherwise(got)


def domain_note(category: Column, final: Column, domain: Column) -> Column:
    """A note on an address that is fine though its list names another domain."""
    return F.when((category == "ok") & (F.coalesce(final, F.lit("")) != "") & (final != F.coalesce(domain, F.lit(""))), F.concat(F.lit("domain "), F.coalesce(domain, F.lit("")), F.lit(" mismatches host "), final))


def message_fault(role: Column, text: Column, blocks: Column) -> Column:
    """Why a message (with a text, or blocks) is refused, by the first fault; null if it is fine."""

    def fault(b: Column) -> Column:
        of_text = F.when(b["text"].isNull(), "block without text").when(F.octet_length(b["text"]) > MAX_BYTES, "block too long")
        of_image = F.when((F.coalesce(b["source_type"], F.lit("")) != "base64") | b["data"].isNull(), "image malformed")
        return F.when(b.isNull(), "no block").when(b["type"] == "text", of_text).when(b["type"] == "image", of_image).otherwise("unknown block")

    first = F.get(F.filter(F.transform(blocks, fault), lambda x: x.isNotNull()), F.lit(0))
    content = F.when(text.isNotNull(), F.when(F.octet_length(text) > MAX_BYTES, "too long")).when(blocks.isNotNull(), first).otherwise("no content")
    return F.when(role.isNull() | ~role.isin("user", "assistant"), "role").otherwise(content)


def request_fault(faults: Column, max_tokens: Column) -> Column:
    """Why a request is refused: no messages, the first message's fault, or its number of tokens. faults: one entry (or null) per message."""
    first = F.get(F.filter(faults, lambda x: x.isNotNull()), F.lit(0))
    return F.when(faults.isNull() | (F.size(faults) == 0), "no messages").when(first.isNotNull(), first).when((max_tokens < 1) | (max_tokens > MAX_TOKENS), "max_tokens")
