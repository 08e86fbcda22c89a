"""Classes of vendor errors, and what they allow. ``vendor`` is 'a' or 'b'; matching ignores case."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases by which vendors report faults.
GONE = "(?i)no longer available|not found|is not supported"
GONE_OR_UNFIT = "(?i)no longer available|not found|is not supported|does not support"
BAD_KEY = "(?i)API key not valid"
DISABLED = "(?i)SERVICE_DISABLED|has not been used in project"
BLOCKED = "(?i)blocked|referer|referrer"
B_GONE = "(?i)model_not_found|does not exist|decommissioned"
B_NO_IMAGES = "(?i)does not support image|vision|multimodal"
B_RETRY = "(?i)model_not_found|decommissioned|does not support image|vision|multimodal"
POOL_401, POOL_403, POOL_400 = "(?i)invalid_api_key|invalid api key", "(?i)SERVICE_DISABLED|quota|has not been used in project", "(?i)API key not valid|API_KEY_INVALID"


def vendor_message(body: Column) -> Column:
    """The message in an error body, '' if there is none or the body is no JSON."""
    return F.coalesce(F.get_json_object(body, "$.error.message"), F.lit(""))


def classify_error(vendor: Column, status: Column, body: Column) -> Column:
    """The first class that fits: model-gone, bad-key, api-disabled, key-restricted, denied, too-large, rate-limited, no-images, server-error or failed."""
    text, detail = F.coalesce(body, F.lit("")), vendor_message(body)
    a = (
        F.when(detail.rlike(GONE), "model-gone").when((status == 400) & text.rlike(BAD_KEY), "bad-key").when((status == 403) & text.rlike(DISABLED), "api-disabled")
        .when((status == 403) & text.rlike(BLOCKED), "key-restricted").when(status == 403, "denied").when(status == 413, "too-large")
        .when(status == 429, "rate-limited").when(status == 404, "model-gone").when(status >= 500, "server-error").otherwise("failed")
    )
    b = (
        F.when(status == 401, "bad-key").when((status == 404) | text.rlike(B_GONE), "model-gone").when(text.rlike(B_NO_IMAGES), "no-images")
        .when(status == 413, "too-large").when(status == 429, "rate-limited").when(status >= 500, "server-error").otherwise("failed")
    )
    return F.when(vendor == "b", b).otherwise(a)


def block_class(reason: Column) -> Column:
    """Why a vendor refused an answer: safety, prohibited or blocked."""
    return F.when(reason.rlike("(?i)SAFETY"), "safety").when(reason.rlike("(?i)PROHIBITED_CONTENT|BLOCKLIST"), "prohibited").otherwise("blocked")


def retryable(vendor: Column, status: Column, body: Column) -> Column:
    """Whether another model may succeed. Vendor 'a' is judged by its message, 'b' by the whole body."""
    by_status = status.isin(404, 429) | (status >= 500)
    said = F.when(vendor == "b", F.coalesce(body, F.lit("")).rlike(B_RETRY)).otherwise(vendor_message(body).rlike(GONE_OR_UNFIT))
    return F.coalesce(by_status, F.lit(False)) | said


def key_exhausted(status: Column, body: Column) -> Column:
    """Whether the next key of a pool is worth trying."""
    text = F.coalesce(body, F.lit(""))
    return F.coalesce((status == 429) | ((status == 401) & text.rlike(POOL_401)) | ((status == 403) & text.rlike(POOL_403)) | ((status == 400) & text.rlike(POOL_400)), F.lit(False))
