"""Error rules and retry markers as data. Pass your own lists to the operators to extend them."""

from __future__ import annotations

# ---- Fixed values -------------------------------------------------------------------------------

# Object-store error code -> (class, retryable). Stage is always the destination write.
STORE_CODES = {
    "NoSuchBucket": ("DestNoSuchBucket", False),
    "NoSuchKey": ("DestNoSuchKey", False),
    "AccessDenied": ("AccessDenied", False),
    "InvalidAccessKeyId": ("InvalidAccessKeyId", False),
    "SignatureDoesNotMatch": ("SignatureDoesNotMatch", False),
    "AuthorizationHeaderMalformed": ("AuthorizationHeaderMalformed", False),
    "ExpiredToken": ("ExpiredToken", False),
    "NoSuchUpload": ("DestNoSuchUpload", False),
    "InvalidPart": ("DestInvalidPart", False),
    "InvalidPartOrder": ("DestInvalidPartOrder", False),
    "EntityTooSmall": ("DestEntityTooSmall", False),
    "SlowDown": ("DestSlowDown", True),
    "RequestTimeout": ("DestRequestTimeout", True),
    "InternalError": ("InternalError", True),
    "ServiceUnavailable": ("ServiceUnavailable", True),
}

# HTTP status of a source read -> (class, retryable); other 5xx and the rest follow.
SOURCE_STATUS = {
    404: ("SourceNotFound", False),
    403: ("SourceAccessDenied", False),
    416: ("SourceInvalidRange", False),
    429: ("SourceRateLimited", True),
    408: ("SourceTimeout", True),
}
SOURCE_5XX = ("SourceUpstreamError", True)
SOURCE_OTHER = ("SourceFetchFailed", False)

# HTTP status of a destination write -> (class, retryable).
DEST_STATUS = {
    429: ("DestRateLimited", True),
    408: ("DestTimeout", True),
    404: ("DestNotFound", False),
    403: ("DestAccessDenied", False),
    400: ("DestBadRequest", False),
}
DEST_5XX = ("DestUpstreamError", True)
DEST_OTHER = ("DestUploadFailed", False)

# Network phrases -> (class, retryable), in order of precedence.
NETWORK_PHRASES = [
    (("timed out", "timeout"), "NetworkTimeout", True),
    (
        (
            "network connection lost",
            "connection lost",
            "connection closed",
            "stream closed",
            "socket closed",
            "socket hang up",
            "connection reset",
            "econnreset",
            "upstream connect error",
            "fetch failed",
        ),
        "NetworkConnectionLost",
        True,
    ),
    (("dns", "enotfound"), "DnsFailure", True),
    (("invalid url", "unsupported protocol"), "InvalidUrl", False),
]

# Markers that make a response final whatever its status says.
FATAL_MARKERS = [
    "missing required environment variables",
    "missing required parameters",
    "missing required parameter",
    "signaturedoesnotmatch",
    "invalidaccesskeyid",
    "accessdenied",
    "access denied",
    "forbidden",
    "authorizationheadermalformed",
    "invalidargument",
    "invalidrequest",
    "invalid token",
    "expiredtoken",
    "request has expired",
    "nosuchbucket",
    "no such bucket",
    "nosuchkey",
    "no such key",
    "nosuchupload",
    "entitytoosmall",
    "invalidpart",
    "invalidpartorder",
    "etag missing",
    "no etag found",
]

# Response statuses worth another try.
RETRYABLE_STATUS = [408, 425, 429, 500, 502, 503, 504]

# Failures while listing uploaded parts that are worth another try.
LIST_PARTS_RETRYABLE = [
    "context deadline exceeded",
    "timeout",
    "i/o timeout",
    "connection reset",
    "connection refused",
    "connection aborted",
    "broken pipe",
    "unexpected eof",
    "server closed idle connection",
    "tls handshake timeout",
    "status code: 500",
    "status code: 502",
    "status code: 503",
    "status code: 504",
    "statuscode: 500",
    "statuscode: 502",
    "statuscode: 503",
    "statuscode: 504",
    "statuscode:500",
    "statuscode:502",
    "statuscode:503",
    "statuscode:504",
]

# Download failures worth another try.
DOWNLOAD_RETRYABLE = [
    "http status 403",
    "403 forbidden",
    "server gave http response to https client",
    "eof",
    "connection reset by peer",
    "incomplete upload",
    "collect parts timeout",
    "missing etag",
    "context deadline exceeded",
    "http status 429",
    "http status 500",
    "http status 502",
    "http status 503",
    "http status 504",
]

# Metadata extraction: final phrases override the retryable ones.
METADATA_FINAL = [
    "private video",
    "members-only",
    "removed by the uploader",
    "video has been removed",
    "video has been deleted",
    "copyright",
    "account associated with this video has been terminated",
    "this video is no longer available because",
]
METADATA_RETRYABLE = [
    "sign in to confirm",
    "you're not a bot",
    "age-restricted",
    "video unavailable",
    "this video is restricted",
    "not available in your country",
    "http error 429",
    "http error 500",
    "http error 502",
    "http error 503",
    "http error 504",
    "timed out",
    "timeout",
    "temporarily unavailable",
    "remote end closed connection",
    "connection reset",
    "proxy error",
]

# Copy tasks: failures that a retry cannot mend.
COPY_PERMANENT = [
    "sourcenotfound",
    "source fetch returned 404",
    "zerosizedisabled",
    "zero-byte transfer disabled by config",
]

# Bulk retry of downloads: failures that a retry cannot mend.
DOWNLOAD_PERMANENT = [
    "sign in to confirm you're not a bot",
    "this video is not available",
    "video unavailable",
    "this video is restricted",
    "private video",
    "members-only",
    "removed by the uploader",
    "copyright",
]

# Text of the bot check (apostrophes are normalised before matching).
BOT_CHECK = "Sign in to confirm you're not a bot"
