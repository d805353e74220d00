"""Written cases of the URL and channel rules, for a query and for tests."""

from __future__ import annotations

LONG = ".".join(["a" * 63] * 4)

#: (given, seen from, normal URL)
URLS: tuple[tuple[str, str | None, str | None], ...] = (
    ("HTTPS://WWW.Shop.Example:443/a b?utm_source=1&x=2#f", None, "https://www.shop.example/a%20b?x=2"),
    ("http://shop.example", None, "http://shop.example/"),
    ("http://shop.example:8080/", None, "http://shop.example:8080/"),
    ("http://shop.example:bad/", None, None),
    ("http://shop.example:70000/", None, None),
    ("http://[2001:db8::1]:80/x", None, "http://[2001:db8::1]/x"),
    ("ftp://shop.example/", None, None),
    ("https://bücher.example/ü", None, "https://xn--bcher-kva.example/%C3%BC"),
    ("https://straße.de/", None, None),
    ("https://xn--strae-oqa.de/", None, "https://xn--strae-oqa.de/"),
    ("https://a_b.example.com/", None, None),
    ("https://-a.example/", None, None),
    ("https://a..example/", None, None),
    ("https://shop.example./x", None, "https://shop.example/x"),
    (f"https://{LONG}/", None, None),
    (f"https://{'a' * 63}.example/", None, f"https://{'a' * 63}.example/"),
    (f"https://{'a' * 64}.example/", None, None),
    ("", None, None),
    ("   ", None, None),
    ("shop", None, None),
    ("https:///x", None, None),
    ("https://a.example/?q=%FF", None, None),
    ("https://a.example/?a=1&amp;b=2", None, "https://a.example/?a=1&b=2"),
    ("https://a.example/?a&b=&c=x y", None, "https://a.example/?a=&b=&c=x+y"),
    ("https://a.example/?q=~*", None, "https://a.example/?q=~%2A"),
    ("https://a.example/%zz?GCLID=1&UTM_X=2", None, "https://a.example/%zz"),
    ("https://user:pw@a.example/p", None, "https://a.example/p"),
    ("../x", "https://a.example/b/c", "https://a.example/x"),
    ("./d/../e?k=1", "https://a.example/b/c", "https://a.example/b/e?k=1"),
    ("/m#top", "https://a.example/b/c", "https://a.example/m"),
    ("?q=1", "https://a.example/b/c", "https://a.example/b/c?q=1"),
    ("#top", "https://a.example/b/c?z=1", "https://a.example/b/c?z=1"),
    ("//b.example/y", "https://a.example/b/c", "https://b.example/y"),
    ("menu", "https://a.example", "https://a.example/menu"),
    ("mailto:x@a.example", "https://a.example/b", None),
    ("https://b.example/../z", "https://a.example/b", "https://b.example/../z"),
)

#: (URL, URL, whether both are of one site)
SITES: tuple[tuple[str, str, int], ...] = (
    ("https://www.a.example/x", "http://A.example:80/q", 1),
    ("https://a.example", "https://b.a.example/", 0),
    ("https://example.com:bad/a", "https://example.com/", 0),
    ("https://bücher.example/", "https://xn--bcher-kva.example/z", 1),
    ("https://straße.de/", "https://strasse.de/", 0),
    ("nothing", "nothing", 0),
)

#: (target, text, channel, identifier)
CHANNELS: tuple[tuple[str, str, str | None, str | None], ...] = (
    ("https://a.example/x", "Our story", None, None),
    ("https://a.example/", "Website", None, None),
    ("mailto:Info@Shop.example?subject=a", "Book now", "email", "info@shop.example"),
    ("mailto:nobody", "", None, None),
    ("tel:0049 (30) 123456", "Call", "phone", "+4930123456"),
    ("tel:none", "", None, None),
    ("https://wa.me/49301234567", "Chat", "whatsapp", "https://wa.me/49301234567"),
    ("https://wa.me/1", "Chat", None, None),
    ("https://wa.me/c/49301234567", "", "whatsapp", "https://wa.me/c/49301234567"),
    ("https://wa.me/message/ABC", "", "whatsapp", "https://wa.me/message/ABC"),
    ("https://api.whatsapp.com/send?phone=+49301234567", "", "whatsapp", "https://api.whatsapp.com/send?phone=+49301234567"),
    ("https://api.whatsapp.com/send?text=hi", "", None, None),
    ("https://whatsapp.com/channel/X1", "", "whatsapp", "https://whatsapp.com/channel/X1"),
    ("https://web.whatsapp.com/channel/X1", "", None, None),
    ("https://www.instagram.com/shop", "ig", "instagram", "https://www.instagram.com/shop"),
    ("https://www.instagram.com/p/1", "post", None, None),
    ("https://m.facebook.com/Shop?utm_source=a", "", "facebook", "https://m.facebook.com/Shop"),
    ("https://facebook.com/sharer/x", "", None, None),
    ("https://linkedin.com/company/a", "", "linkedin", "https://linkedin.com/company/a"),
    ("https://linkedin.com/in/a", "", None, None),
    ("https://x.com/shop", "", "x", "https://x.com/shop"),
    ("https://twitter.com/intent/tweet", "", None, None),
    ("https://tiktok.com/@shop", "", "tiktok", "https://tiktok.com/@shop"),
    ("https://tiktok.com/shop", "", None, None),
    ("https://youtube.com/c/shop", "", "youtube", "https://youtube.com/c/shop"),
    ("https://youtu.be/abc", "", None, None),
    ("https://notx.com/shop", "", None, None),
    ("https://a.example/x", "Book now", "booking", "https://a.example/x"),
    ("https://a.example/x", "Reservations", "booking", "https://a.example/x"),
    ("https://a.example/x", "Booking policy", None, None),
    ("https://a.example/x", "Our book history", None, None),
    ("https://a.example/x", "Schedule a visit", "booking", "https://a.example/x"),
    ("https://a.example/x", "Appointment online", "booking", "https://a.example/x"),
    ("https://www.calendly.com/me", "", "booking", "https://www.calendly.com/me"),
    ("https://a.example/x", "Order food online", "ordering", "https://a.example/x"),
    ("https://a.example/order", "Our story", None, None),
    ("https://ubereats.com/store/1", "", "ordering", "https://ubereats.com/store/1"),
    ("https://a.example/help", "Support", "support", "https://a.example/help"),
    ("https://a.example/help", "More", None, None),
)
