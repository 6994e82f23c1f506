"""A plain sequential admission, one request after the other, to check the operator against."""

import re
from decimal import Decimal

EMAIL = re.compile(r"[^\s\ufeff@]+@[^\s\ufeff@]+\.[^\s\ufeff@]+")


def admit(requests, events, types, promos, existing, mode):
    public = mode == "public"
    events = {e["id"]: e for e in events}
    types = {t["id"]: dict(t) for t in types}
    promos = {(p["event_id"], p["code"]): dict(p) for p in promos}
    present = [(r["event_id"], r["email"], r["status"]) for r in existing] if public else []
    out = {}

    def decide(q):
        now = q["requested_at"]
        if public:
            if not q["first_name"] or not q["last_name"] or not q["email"] or q["ticket_type_id"] is None:
                return "MISSING_FIELD", None
            if not EMAIL.fullmatch(q["email"]):
                return "EMAIL_INVALID", None
        event = events.get(q["event_id"])
        if event is None or event["status"] != "PUBLISHED":
            return "EVENT_NOT_PUBLISHED", None
        kind = types.get(q["ticket_type_id"])
        if kind is None or kind["event_id"] != q["event_id"] or not kind["is_active"]:
            return "TICKET_INACTIVE", None
        early = kind["sale_start"] is not None and now < kind["sale_start"]
        ended = kind["sale_end"] is not None and now > kind["sale_end"]
        window = "SALE_NOT_STARTED" if early else "SALE_ENDED" if ended else None
        gone = kind["quantity"] is not None and kind["sold"] >= kind["quantity"]
        if public:
            if window:
                return window, None
            if gone:
                return "SOLD_OUT", None
            live = [p for p in present if p[0] == q["event_id"] and p[2] in ("CONFIRMED", "MANUAL", "PENDING")]
            if event["capacity"] and len(live) >= event["capacity"]:
                return "EVENT_FULL", None
            if any(p[0] == q["event_id"] and p[1] == q["email"].lower() and p[2] != "CANCELLED" for p in present):
                return "DUPLICATE_EMAIL", None
        else:
            if gone:
                return "SOLD_OUT", None
            if window:
                return window, None
        price = Decimal(kind["price"])
        discount, final, promo = Decimal(0), price, None
        if q["promo_code"]:
            code = q["promo_code"].upper() if public else q["promo_code"].strip().upper()
            promo = promos.get((q["event_id"], code))
            if (
                promo is None
                or not promo["is_active"]
                or (promo["expires_at"] is not None and not promo["expires_at"] > now)
                or (promo["max_uses"] is not None and promo["used_count"] >= promo["max_uses"])
            ):
                return "PROMO_INVALID", None
            value = Decimal(promo["discount_value"])
            if promo["discount_type"] == "PERCENTAGE":
                discount = price * value / 100
            else:
                discount = min(value, price)
            final = max(Decimal(0), price - discount)
            if not public:
                discount = price - final
            promo["used_count"] += 1
        kind["sold"] += 1
        status = "CONFIRMED" if final == 0 else "PENDING"
        present.append((q["event_id"], q["email"].lower(), status))
        return "ACCEPTED", (status, promo and promo["id"], final, discount)

    for q in sorted(requests, key=lambda q: (q["requested_at"], q["request_id"])):
        out[q["request_id"]] = decide(q)
    return out
