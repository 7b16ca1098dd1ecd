"""Made-up pages whose article is known: what the block labeller is trained and tested on."""

from __future__ import annotations

import random

#: What pages say outside their articles.
MENU = "Home|About|About us|Contact|News|Sports|Products|Services|Blog|Shop|Help|FAQ|Log in|Sign up|My account|Search|Archive|Topics|Video|Weather|Careers|Press|Startseite|Kontakt|Accueil|Inicio|Impressum|Terms|Privacy|Next|Previous|More"
NOTICES = "We use cookies to improve your experience. By continuing you accept our policy.|This site uses cookies. Accept all|Your privacy matters to us. Manage consent preferences.|Please enable JavaScript to view this page.|You are using an outdated browser. Please upgrade.|Scheduled maintenance this Sunday.|Wir verwenden Cookies.|Ce site utilise des cookies."
ADVERTS = "Advertisement|Sponsored content|Buy now and save 50%|Limited offer: subscribe today!|Promoted|Ad|Shop the sale|Anzeige|Publicité"
FOOTERS = "© 2021 Example Media. All rights reserved.|Copyright 2020|Terms of Service|Privacy Policy|Imprint|Powered by ExamplePress|Follow us on social media|Contact us: info@example.org|Back to top"
FORMS = "Subscribe to our newsletter|Enter your email address|Your name|Leave a reply|Submit|Search this site|Sign in to continue|Password|Sign up"
SIDES = "Most read|Related articles|Recommended for you|Trending now|Popular posts|Categories|Tags|Recent comments|You may also like|Share this|Read more"
SPEAKERS = "says:|wrote:|Reply|5 replies|Like|Report|2 hours ago|Posted by guest"

SOUNDS = ["the th in er re on at en nd ti es or ing of ed is it al ar st to nt ha ou ea ly", "der ein sch ung ch ge en be ver te ieh lich auf und zu heit", "le que en re tion de un eau oi aux ment la et pour ent air", "de que la os ar es ción mente ado en el los por una ida", "ka to mi ra no shi te na ku ri ha so", "за по не ст на ко ра ни ть ов"]
GOOD = ["article", "main", 'div class="content"', 'div class="article-body"', 'div class="post"', 'div id="content"', 'div class="entry-content"', 'section class="story"', 'div role="main"', 'section', 'div', 'div class="post-content text"', 'div id="main"']
NAV = ["nav", 'div class="nav"', 'div class="menu"', 'ul class="navbar"', 'div id="navigation"', 'div class="breadcrumb"', 'div role="navigation"', 'nav class="pagination"', 'ul class="menu"', 'div class="top-menu"']
HEADER = ["header", 'div class="header"', 'div id="masthead"', 'div class="site-header"', 'header class="banner"']
FOOTER = ["footer", 'div class="footer"', 'div id="footer"', 'div class="site-footer"', 'footer class="page-footer"', 'div role="contentinfo"']
SIDE = ["aside", 'div class="sidebar"', 'div id="sidebar"', 'div class="related"', 'div class="widget"', 'aside class="recommended"', 'div class="share social"', 'section class="related-posts"', 'div class="tags"']
AD = ['div class="ad"', 'div class="ads"', 'div class="advert"', 'div class="advertisement"', 'div class="sponsored"', 'div class="promo"', 'aside class="ad"', 'div id="ad-top"', 'section class="promo banner"', 'p class="ad"']
NOTICE = ['div class="cookie-notice"', 'div class="notice"', 'div id="cookie-banner"', 'div class="alert"', 'div class="consent"', 'div role="alert"', 'div class="gdpr popup"', 'div role="dialog"', 'p class="notice"']
COMMENT = ['div class="comments"', 'section id="comments"', 'div class="comment-list"', 'ol class="comments"', 'div id="disqus-thread" class="comments"', 'section class="reader-comments"', 'div class="responses"']


def page(seed: int) -> tuple[str, set[str]]:
    """A page's HTML and the texts of the blocks of its article. Pages differ in language, layout, markup and tidiness."""
    r = random.Random(seed)
    sounds = r.choice(SOUNDS).split()
    pick = lambda s: r.choice(s.split("|") if isinstance(s, str) else s)
    article: set[str] = set()
    junk = r.choice(["marks", "bars", "shouts", *[""] * 17])

    def word() -> str:
        return "".join(r.choice(sounds) for _ in range(r.choice([1, 1, 2, 2, 3]))) + (r.choice(["###", "***", "!!", "$$$"]) if junk == "marks" and r.random() < 0.7 else "")

    def prose(low: int, high: int) -> str:
        out, start = [], True
        for _ in range(r.randint(low, high)):
            w = word()
            w, start = (w.capitalize() if start else w), False
            if r.random() < 0.12:
                w, start = w + r.choice([".", ".", ".", ",", "?"]), True
            out.append(w)
        text = (" | " if junk == "bars" and r.random() < 0.7 else " ").join(out)
        return text.upper() + "!!" if junk == "shouts" else text + r.choice(["."] * 9 + [""])

    def wrapped(tag: str, body: str) -> str:
        return f"<{tag}>{body}</{tag.split()[0]}>"

    def outside(text: str) -> str:
        article.discard(text)
        return text

    def linked(texts: list[str]) -> str:
        way = r.random()
        items = [f'<a href="/{word()}">{outside(t)}</a>' for t in texts]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if way < 0.7 else "".join(f"<div>{x}</div>" for x in items) if way < 0.85 else "".join(f"<span>{x}</span> | " for x in items)

    def menu() -> str:
        return wrapped(pick(NAV), linked([pick(MENU) if r.random() < 0.5 else word() for _ in range(r.randint(2, 9))]))

    def advert() -> str:
        body = prose(2, 40) if r.random() < 0.6 else pick(ADVERTS)
        return wrapped(pick(AD), body if r.random() < 0.6 else f"<p>{body}</p>" if r.random() < 0.6 else f'<a href="/x">{body}</a>')

    def notice() -> str:
        return wrapped(pick(NOTICE), wrapped("p", pick(NOTICES)) + ("<button>OK</button>" if r.random() < 0.5 else "") if r.random() < 0.7 else prose(4, 30))

    def form() -> str:
        body = "".join(f"<label>{pick(FORMS)}</label><input name=x>" if r.random() < 0.5 else f"<p>{pick(FORMS) if r.random() < 0.6 else prose(3, 16)}</p>" for _ in range(r.randint(1, 3)))
        return wrapped(r.choice(["form", 'form class="search"', 'form action="/subscribe"']), body + "<button>" + pick(FORMS) + "</button>") if r.random() < 0.8 else wrapped('div class="newsletter subscribe"', body)

    def side() -> str:
        body = wrapped(r.choice(["h3", "h4", "p", "div"]), pick(SIDES))
        body += linked([prose(3, 9) for _ in range(r.randint(1, 6))]) if r.random() < 0.6 else "".join(f"<p>{prose(4, 35)}</p>" for _ in range(r.randint(1, 3)))
        return wrapped(pick(SIDE), body)

    def comments() -> str:
        one = lambda: wrapped(r.choice(['div class="comment"', "li", 'article class="comment"', "div"]), (f"<span>{word()} {pick(SPEAKERS)}</span>" if r.random() < 0.6 else "") + "".join(f"<p>{prose(3, 50)}</p>" for _ in range(r.choice([1, 1, 2]))) + (f"<a href=#>{pick(SPEAKERS)}</a>" if r.random() < 0.3 else ""))
        return wrapped(pick(COMMENT), (f"<h3>{r.choice(['Comments', 'Reader comments', '3 Comments', 'Responses'])}</h3>" if r.random() < 0.6 else "") + "".join(one() for _ in range(r.randint(1, 5))))

    def footer() -> str:
        body = f"<p>{pick(FOOTERS)}</p>" * r.choice([0, 1]) + (linked([pick(FOOTERS) for _ in range(r.randint(1, 5))]) if r.random() < 0.4 else f"{pick(FOOTERS)} {prose(2, 20)}")
        return wrapped(pick(FOOTER), body)

    def header() -> str:
        return wrapped(pick(HEADER), f'<a href="/">{word().title()}</a>' + (f"<p>{prose(2, 8)}</p>" if r.random() < 0.4 else "") + (menu() if r.random() < 0.4 else ""))

    def said(text: str) -> str:
        article.add(text)
        return text

    def part() -> str:
        way = r.random()
        if way < 0.62:
            text = said(prose(*r.choice([(1, 4), (5, 30), (20, 120), (60, 200)])))
            if r.random() < 0.2:
                w = text.split()
                k = r.randrange(len(w))
                text = " ".join([*w[:k], f"<{(t := r.choice(['b', 'em', 'a href=/z', 'code', 'strong']))}>{w[k]}</{t.split()[0]}>", *w[k + 1 :]])
            return f"<p>{text}</p>" if r.random() < 0.9 else f"<div>{text}</div>"
        if way < 0.72:
            return wrapped(r.choice(["h2", "h3"]), said(prose(1, 8).rstrip(".")))
        if way < 0.82:
            return wrapped(r.choice(["ul", "ol"]), "".join(f"<li>{said(prose(1, 20))}</li>" for _ in range(r.randint(1, 5))))
        if way < 0.88:
            return wrapped("blockquote", f"<p>{said(prose(5, 50))}</p>")
        if way < 0.92:
            return "<figure><img src=x>" + wrapped("figcaption", said(prose(2, 14))) + "</figure>"
        if way < 0.96:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{said(prose(1, 4))}</td>" for _ in range(2)) + "</tr>" for _ in range(r.randint(1, 3))) + "</table>"
        return f"<pre>{said(prose(3, 20))}</pre>"

    title = prose(2, 11).rstrip(".")
    outer = [menu, menu, header, advert, notice, form, side]
    before = [r.choice(outer)() for _ in range(r.choice([0, 1, 1, 2, 3, 4]))]
    after = [r.choice([side, side, comments, advert, form, footer, menu, notice])() for _ in range(r.choice([0, 0, 1, 2, 3]))]
    body = []
    if r.random() < 0.85:
        head = wrapped("h1", said(title))
        body.append(head if r.random() < 0.85 else f"<header>{head}</header>")
    if r.random() < 0.25:
        lead = said(prose(3, 80))
        body.append(f"<p><b>{lead}<br>")
    for _ in range(r.choice([0, 1, 2, 4, 8, 14, 25])):
        body.append(part())
        if r.random() < 0.05:
            body.append(r.choice([advert, side, form])())
        if r.random() < 0.05:
            body.append(f"<p><b>{said(prose(4, 60))}<br>")
    if not article:
        body.append(f"<p>{said(prose(8, 60))}</p>")
    tag = pick(GOOD) if r.random() < 0.6 else "article"
    kept = f"<{tag}>{''.join(body)}</{tag.split()[0]}>"
    if r.random() < 0.3:
        kept = f'<div class="{r.choice(["wrapper", "container", "page", "row", "site"])}">{kept}</div>'
    if r.random() < 0.12:
        after.append(comments())
    if r.random() < 0.7:
        after.append(footer())
    if r.random() < 0.03:
        return "".join(body), article
    top = f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>" if r.random() < 0.9 else ""
    out = top + "".join(before) + kept + "".join(after) + ("</body></html>" if r.random() < 0.9 else "")
    return out, article
