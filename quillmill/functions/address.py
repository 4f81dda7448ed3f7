"""Mail addresses and bulk-mail rules as Column expressions.

Every function takes and returns Columns; a null header counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmill.functions.let import let
from quillmill.functions.vocabulary import PERSONAL_DOMAINS

#: Local parts that mean automated mail, as regular expressions that begin a local part and end at a word's end.
BULK_LOCALS = (
    "accounts?|admins?|announcements?|billing|bounces?|community|contact|digest|donotreply|editorial|events?|hello|hi|info|"
    "mailer-daemon|marketing|media|newsletters?|no-?reply|notifications?|onboarding|postmaster|press|reminders?|sales|security|support|team|updates?"
)
#: Those that mean it even at a personal provider.
SYSTEM_LOCALS = "bounces?|donotreply|mailer-daemon|mailer|newsletters?|no-?reply|postmaster"
#: Mass-mail domains: any host below one of these, and the bare domains that are senders themselves.
BULK_HOSTS = (
    "amazonses.com ccsend.com constantcontact.com eventbritemail.com fbsbx.com hubspotmail.net intercom-mail.com list-manage.com "
    "luma-mail.com mailchimp.com mailchimpapp.com mailgun.org mandrillapp.com salesforce.com sendgrid.net substack.com"
).split()
BULK_BARE_HOSTS = ["luma-mail.com", "redditads.com", "substack.com"]
CALENDAR_LOCALS = ["calendar", "calendar-noreply", "calendar-notification"]
CALENDAR_HOST = "google.com"

_IMAGE = "bmp|gif|jpeg|jpg|png|svg|tiff|webp"

#: Pieces of address patterns: what stands on either side of an @ between angle brackets, and bare.
INSIDE, BARE = r"[^@<>\s]+", r"[^,;<>\s]+"
ANGLE_ADDRESS, BARE_ADDRESS = f"<({INSIDE}@{INSIDE})>", f"({BARE}@{BARE})"
NAME, HOST = r"[-+.\w]+", r"[-.A-Za-z0-9]+"
_TAGGED, _HEX = "[^<>]+", "[0-9a-f]{8,}"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def address(header: Column) -> Column:
    """The address in a header: between angle brackets, else the first bare one; lower case, '' if there is none."""
    h = F.trim(_text(header))
    angle = F.regexp_extract(h, ANGLE_ADDRESS, 1)
    bare = F.regexp_extract(h, BARE_ADDRESS, 1)
    return F.lower(F.when(angle != "", angle).otherwise(bare))


def local_part(addr: Column) -> Column:
    """What stands before the last @; '' without one."""
    return F.when(addr.contains("@"), F.regexp_extract(addr, r"(?s)^(.*)@", 1)).otherwise(F.lit(""))


def domain(addr: Column) -> Column:
    """What stands behind the last @; '' without one."""
    return F.when(addr.contains("@"), F.substring_index(addr, "@", -1)).otherwise(F.lit(""))


def is_personal_domain(host: Column) -> Column:
    return F.lower(_text(host)).isin(sorted(PERSONAL_DOMAINS))


def is_system_local(local: Column) -> Column:
    return _text(local).rlike(rf"(?i)^(?:{SYSTEM_LOCALS})\b")


def is_calendar_mailer(header: Column) -> Column:
    """Whether the sender is the calendar service's own mailer."""
    return let(address(header), _from_calendar)


def _from_calendar(a: Column) -> Column:
    host = domain(a)
    return local_part(a).isin(CALENDAR_LOCALS) & ((host == CALENDAR_HOST) | host.endswith("." + CALENDAR_HOST))


def is_bulk_sender(header: Column) -> Column:
    """Bulk by the sender's address alone: calendar mailers never, personal providers only for system mail."""
    return let(address(header), _bulk_address)


def _bulk_address(a: Column) -> Column:
    local, host = local_part(a), domain(a)
    hosts = "|".join(h.replace(".", r"\.") for h in BULK_HOSTS)
    bare = "|".join(h.replace(".", r"\.") for h in BULK_BARE_HOSTS)
    return (
        F.when(a == "", False)
        .when(_from_calendar(a), False)
        .when(is_personal_domain(host), is_system_local(local))
        .otherwise(local.rlike(rf"(?i)^(?:{BULK_LOCALS})\b") | host.rlike(rf"(?i)(?:\.(?:{hosts})|^(?:{bare}))$"))
    )


def header_value(headers: Column, name: str) -> Column:
    """The value of a header whose name is written in any case; null if there is none."""
    hits = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name.lower())
    return F.try_element_at(hits, F.lit(1))["value"]


def own_addresses(emails: Iterable[str] | None) -> list[str]:
    """A user's addresses as they are compared: parsed from headers where that works, else lower case."""
    import re

    out = set()
    for raw in emails or ():
        raw = (raw or "").strip()
        m = re.search(ANGLE_ADDRESS, raw) or re.search(BARE_ADDRESS, raw)
        if raw:
            out.add((m[1] if m else raw).lower())
    return sorted(out)


def is_bulk_message(headers: Column, sender: Column, user_emails: Iterable[str] | None = None) -> Column:
    """Bulk by headers and sender, first rule first: calendar, own mail, personal senders, list headers, sender."""
    return let(address(sender), lambda a: _bulk_message(headers, a, own_addresses(user_emails)))


def _bulk_message(headers: Column, a: Column, own: list[str]) -> Column:
    list_id = header_value(headers, "list-id")
    precedence = F.lower(F.trim(_text(header_value(headers, "precedence"))))
    automatic = F.lower(F.trim(_text(header_value(headers, "auto-submitted"))))
    return (
        F.when(_from_calendar(a), False)
        .when(a.isin(own) if own else F.lit(False), False)
        .when((a != "") & is_personal_domain(domain(a)) & ~is_system_local(local_part(a)), False)
        .when(F.trim(_text(list_id)) != "", True)
        .when(precedence.isin("bulk", "list", "junk"), True)
        .when((automatic != "") & (automatic != "no"), True)
        .otherwise(_bulk_address(a))
    )


def is_inline_image(addr: Column) -> Column:
    """Whether an address is the content id of an image in a mail, not a mailbox."""
    a = _text(addr)
    local, host = F.substring_index(a, "@", 1), F.regexp_extract(a, r"(?s)^[^@]*@(.*)$", 1)
    odd = (
        local.rlike(rf"(?i)^image\d+\.(?:{_IMAGE})$")
        | local.rlike(r"(?i)^image\d+_")
        | local.rlike(r"(?i)^part\d+\.\d+")
        | local.rlike(rf"(?i)\.(?:{_IMAGE})\b")
        | host.rlike(rf"(?i)^{_HEX}\.{_HEX}$")
    )
    return a.contains("@") & (local != "") & (host != "") & odd


def addresses_in(text: Column) -> Column:
    """All addresses in a text: lower case, sorted, each once.  Trailing dots stay, as they are matched."""
    found = F.regexp_extract_all(_text(text), F.lit(rf"(?U){NAME}@[-\w]+\.[-.\w]+"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, F.lower)))


def header_address(header: Column) -> Column:
    """The first address in a header by the plain ASCII pattern; null if there is none."""
    found = F.regexp_extract(_text(header), f"({NAME}@{HOST})", 1)
    return F.lower(F.nullif(found, F.lit("")))


def header_is_personal(header: Column) -> Column:
    """Whether a header's first address is at a personal provider."""
    host = F.regexp_extract(header_address(header), r"^[^@]*@(.*)$", 1)
    return F.coalesce(is_personal_domain(F.trim(host, F.lit("."))), F.lit(False))


def any_personal(*headers: Column) -> Column:
    """Whether any address in any of the headers is at a personal provider."""
    hosts = F.concat(*[F.regexp_extract_all(_text(h), F.lit(f"{NAME}@({HOST})"), F.lit(1)) for h in headers])
    return F.exists(hosts, lambda h: is_personal_domain(F.trim(h, F.lit("."))))


def sender_display(header: Column) -> Column:
    """The display name before an address in angle brackets, without quotes; '' for bare addresses."""
    raw = F.regexp_extract(_text(header), rf"^\s*(.+?)\s*<{_TAGGED}@{_TAGGED}>\s*$", 1)

    def unquoted(r: Column) -> Column:
        quoted = (F.length(r) >= 2) & ((r.startswith('"') & r.endswith('"')) | (r.startswith("'") & r.endswith("'")))
        return F.trim(F.when(quoted, F.substring(r, F.lit(2), F.length(r) - 2)).otherwise(r))

    return let(raw, unquoted)


def is_attendee_address(addr: Column) -> Column:
    """Whether an address among a calendar mail's guests can be a person's."""
    a = F.lower(_text(addr))
    local, host = local_part(a), domain(a)
    mailers = [f"{x}@{CALENDAR_HOST}" for x in CALENDAR_LOCALS]
    return (local != "") & (host != "") & ~a.isin(mailers) & ~host.endswith(".calendar." + CALENDAR_HOST) & ~local.isin("donotreply", "no-reply", "noreply", "support")


def name_of_address(addr: Column) -> Column:
    """A name made of an address's local part: its pieces between . _ - + with capitals; the address itself if there are none."""
    local = F.substring_index(addr, "@", 1)
    pieces = F.filter(F.split(local, r"[._\-+]"), lambda x: x != "")
    capital = F.transform(pieces, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1 << 20))))
    return F.when(F.size(pieces) == 0, addr).otherwise(F.array_join(capital, " "))
