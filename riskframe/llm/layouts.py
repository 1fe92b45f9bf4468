"""Pages to learn from: texts of the corpus put into many layouts, with what is main text marked.

Regions get their tags and class names at random, telling ones, meaningless ones or none, so that a labeller has to weigh tags, words, measures and place.
"""

from __future__ import annotations

import random

#: Stands in every block of main text that compose() writes.
MARK = "\ue000"

# Class names that sites give to regions, and phrases found in them.
NAMES = {
    "main": "content main-content article-body post-content entry-content story article post entry text body-text maintext page-content story-body article__content prose richtext single-post blog-post",
    "nav": "nav menu navbar navigation main-menu top-menu site-nav breadcrumb breadcrumbs links toc pagination pager tabs submenu",
    "header": "header site-header masthead top topbar page-header banner-top branding logo head",
    "footer": "footer site-footer bottom page-footer foot colophon copyright legal footer-widgets",
    "aside": "sidebar side aside widget widgets rail right-column left-column secondary related related-posts recommended popular trending more-stories teaser tag-cloud tags",
    "notice": "cookie cookie-notice cookie-banner consent gdpr notice notification alert popup modal overlay message announcement disclaimer paywall",
    "ad": "ad ads advert advertisement adbox ad-slot sponsored sponsor promo promotion banner commercial dfp adsense",
    "form": "form signup newsletter subscribe login search-form contact-form subscription register",
    "comments": "comments comment-list comment responses discussion disqus replies reader-comments user-comments feedback",
    "share": "share social social-share sharing share-buttons follow",
}
OTHER_WORDS = frozenset("nav navbar menu breadcrumb breadcrumbs sidebar widget widgets related recommended popular trending teaser cookie consent gdpr notice notification alert popup modal overlay announcement paywall ad ads advert advertisement sponsored sponsor promo promotion commercial newsletter subscribe signup login comments comment responses discussion disqus replies feedback share social sharing pagination pager".split())
PHRASES = {
    "notice": "We use cookies to improve your experience. By continuing to browse this site you agree to our use of cookies.|This website uses cookies|Accept all|Reject all|Manage preferences|Please read our privacy policy for details.|Nous utilisons des cookies pour améliorer votre visite.|Tout accepter|Wir verwenden Cookies, um Ihnen die Nutzung zu erleichtern.|Alle akzeptieren|Usamos cookies para mejorar su experiencia.|Aceptar|Your browser is out of date.|You have read 3 of 5 free articles this month.|Scheduled maintenance on Sunday.|Got it",
    "footer": "All rights reserved.|Privacy policy|Terms of use|Contact us|About us|Imprint|Impressum|Mentions légales|Aviso legal|Tous droits réservés.|Alle Rechte vorbehalten.|Powered by WordPress|Sitemap|Back to top|Follow us on Twitter|Registered office: 12 High Street, London|Tel. 020 7946 0000",
    "form": "Email address|Your name|Password|Subscribe to our newsletter|Sign up|Log in|Search|Forgot your password?|Required fields are marked *|Get the latest stories in your inbox every morning.|Adresse e-mail|S'inscrire|Anmelden|Correo electrónico|Remember me|I agree to the terms",
    "ad": "Advertisement|Sponsored|Sponsored content|Buy now and save 50% on your first order!|Limited offer: only today|Anzeige|Publicité|Publicidad|Shop the new collection|Try it free for 30 days|Best prices guaranteed!|Click here",
    "comments": "Leave a comment|Leave a reply|Reply|Report|Like|Show more comments|Log in to comment|Commentaires|Kommentare|Comentarios|Antworten|Répondre|Responder|Post comment",
    "share": "Share|Tweet|Share on Facebook|Share on Twitter|Email this article|Print|Save|WhatsApp|LinkedIn|Copy link|Partager|Teilen|Compartir",
    "nav": "Home|News|Sport|Business|Culture|Opinion|Weather|Contact|About|Archive|Next|Previous|Skip to content|Menu|Accueil|Startseite|Inicio|Politics|World",
    "aside": "Related articles|Most read|Read more|You may also like|Popular posts|Recent posts|More stories|Tags|Lire aussi|Mehr zum Thema|Recomendados|Top stories|Editor's picks",
    "name": "Anna|Jon_88|maria.g|Pierre D.|guest|K. Schmidt|reader42|Lucía|happycat|Tom B.|Anonymous|elle",
}
_PHRASES = {k: v.split("|") for k, v in PHRASES.items()}
_NAMES = {k: v.split() for k, v in NAMES.items()}
#: To write with where a corpus has no texts of its own.
_WORDS = "the of and to in that it was for on with as his he be at by had not are but from or have an they which one you were her all she there would their we him been has when who will more no if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over man me even most made after also did many before must through back years where much your way well down should because each just those people how too little state good very make world still own see men work long get here between both life being under never day same another know while last might us great old year off come since against go came right used take three".split()


def says_main(names: tuple[str, ...]) -> bool:
    return "article" in names or "main" in names


def says_other(names: tuple[str, ...]) -> bool:
    """Within a page's main element, if it stands inside the innermost of those."""
    start = max((i for i, n in enumerate(names) if n in ("article", "main")), default=0)
    return any(n in ("nav", "footer", "aside", "form", "menu", "search", "dialog") for n in names[start:])


class _Page:
    def __init__(self, rng: random.Random, texts: list[list[str]]):
        self.rng, self.texts = rng, texts
        self.telling = self.one([0.0, 0.5, 0.9, 1.0])  # how many regions have names that tell
        self.tags = rng.random()  # how many have tags that tell
        self.inline = rng.random() < 0.5

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def one(self, options: list):
        return options[int(self.rng.random() * len(options))]

    def upto(self, lo: int, hi: int) -> int:
        """A number from lo to hi, both included."""
        return lo + int(self.rng.random() * (hi - lo + 1))

    def words(self, lo: int, hi: int) -> str:
        """A run of words from one of the texts."""
        n = self.upto(lo, hi)
        own = self.one(self.texts) if self.texts and self.chance(0.9) else []
        if len(own) < n:
            own = own + [self.one(_WORDS) for _ in range(n - len(own))]
        start = self.upto(0, len(own) - n)
        return _escaped(" ".join(own[start : start + n]))

    def title(self) -> str:
        x = self.words(1, 4)
        return x[:1].upper() + x[1:]

    def sentences(self, lo: int, hi: int) -> str:
        out = []
        for _ in range(self.upto(lo, hi)):
            x = self.words(3, 22)
            out.append(x[:1].upper() + x[1:] + ("" if x[-1:] in ".!?" else self.one([".", ".", ".", "!", "?"])))
        return " ".join(out)

    def named(self, kind: str, tags: str = "div section") -> tuple[str, str]:
        """Start and end tag of a region."""
        tag = self.one(tags.split())
        semantic = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "main": "article"}.get(kind)
        if semantic and self.chance(self.tags):
            tag = "main" if kind == "main" and self.chance(0.3) else semantic
        name = ""
        if self.chance(self.telling):
            name = self.one(_NAMES[kind])
            if self.chance(0.2):
                name += " " + self.one(["clearfix", "container", "col-8", "row", "wrapper", "block", "box", "inner"])
        elif self.chance(0.6):
            name = self.one(["", "", "c", "x-", "css-"]) + "".join(self.one(list("abcdefghijklmnopqrstuvwxyz")) for _ in range(self.upto(2, 7)))
        key = self.one(["class", "class", "class", "id"])
        return f'<{tag} {key}="{name}">' if name else f"<{tag}>", f"</{tag}>"

    def within(self, kind: str, inside: str, tags: str = "div section") -> str:
        a, b = self.named(kind, tags)
        for _ in range(self.upto(0, 1)):
            inside = f"<div>{inside}</div>"
        return a + inside + b

    def link(self, text: str) -> str:
        return f'<a href="/{self.upto(0, 999)}">{text}</a>'

    def links(self, lo: int, hi: int, kind: str = "nav") -> str:
        items = [self.link(self.one(_PHRASES[kind]) if self.chance(0.4) else self.title()) for _ in range(self.upto(lo, hi))]
        way = self.upto(0, 3)
        if way == 0:
            return self.one([" | ", " · ", " "]).join(items)
        if way == 1:
            return "".join(f"<div>{x}</div>" for x in items)
        closed = "</li>" if self.chance(0.8) else ""
        return "<ul>" + "".join(f"<li>{x}{closed}" for x in items) + "</ul>"

    def some(self, kind: str, lo: int = 1, hi: int = 3) -> str:
        tag = self.one(["p", "div", "span", "li"])
        return "".join(f"<{tag}>{_escaped(self.one(_PHRASES[kind]))}</{tag}>" for _ in range(self.upto(lo, hi)))

    # Regions beside the main text.

    def menu(self) -> str:
        return self.within("nav", self.links(2, 12))

    def masthead(self) -> str:
        logo = self.one(["", f"<h1>{self.title()}</h1>", f"<div>{self.link(self.title())}</div>", f"<p>{self.words(2, 8)}</p>"])
        return self.within("header", logo + self.one(["", self.menu(), self.links(2, 8), self.search()]) + self.one(["", f"<p>{self.words(3, 9)}</p>"]))

    def search(self) -> str:
        return '<form action="/s"><input name="q"><button>Go</button></form>' if self.chance(0.5) else self.within("form", f"<label>{self.one(_PHRASES['form'])}</label><input>")

    def notice(self) -> str:
        said = self.some("notice", 1, 3) if self.chance(0.6) else f"<p>{self.sentences(1, 2)}</p>" + self.some("notice", 0, 1)
        return self.within("notice", said + self.one(["", "<button>OK</button>", self.link(self.one(_PHRASES["notice"]))]))

    def advert(self) -> str:
        """Without a telling name, an advert has to have telling words or links."""
        said = self.one([self.some("ad", 1, 2), self.link(self.sentences(1, 1)) + self.some("ad", 1, 1)])
        if self.chance(0.5):
            said = self.one([self.sentences(1, 3), f"<p>{self.sentences(1, 2)}</p>", f"<h3>{self.title()}</h3><p>{self.sentences(1, 1)}</p>"])
            tag = self.one(["div", "aside", "section", "p"]) if "<" not in said else "div"
            return f'<{tag} {self.one(["class", "id"])}="{self.one(_NAMES["ad"])}{self.one(["", "", " box", "-1", "_top"])}">{said}</{tag}>'
        return self.within("ad", said)

    def signup(self) -> str:
        """Forms say so by their tag or their class."""
        fields = "".join(f"<label>{_escaped(self.one(_PHRASES['form']))}</label><input>" for _ in range(self.upto(1, 3)))
        said = self.one(["", f"<h3>{self.one(_PHRASES['form'])}</h3>", f"<p>{self.sentences(1, 2)}</p>"]) + self.some("form", 0, 2)
        body = f"<form>{said}{fields}<button>OK</button></form>"
        return body if self.chance(0.4) else self.within("form", body)

    def teasers(self) -> str:
        out = self.one(["", f"<h3>{self.one(_PHRASES['aside'])}</h3>", f"<h2>{self.title()}</h2>"])
        for _ in range(self.upto(1, 5)):
            tag = self.one(["div", "li", "article", "section"])
            klass = f' class="{self.one(["teaser", "card", "item", "summary", "related-item"])}"' if tag == "article" or self.chance(0.4) else ""
            out += f"<{tag}{klass}><h4>{self.link(self.words(3, 9))}</h4>{self.one(['', f'<p>{self.words(4, 16)}</p>', f'<p>{self.sentences(1, 1)} ' + self.link('Read more') + '</p>'])}</{tag}>"
        return out

    def sidebar(self) -> str:
        parts = []
        for _ in range(self.upto(1, 3)):
            parts.append(self.one([self.links(3, 10, "aside"), self.teasers(), self.advert(), self.signup(), f"<h3>{self.one(_PHRASES['aside'])}</h3>" + self.links(2, 8, "aside"), f"<h4>{self.title()}</h4><p>{self.sentences(1, 2)}</p>"]))
        if self.chance(0.3):
            a, b = self.one([("<aside>", "</aside>"), (f'<div id="{self.one(["sidebar", "right", "rail", "side"])}">', "</div>")])
            return a + "".join(parts) + b
        return self.within("aside", "".join(parts))

    def related(self) -> str:
        return self.within("aside", self.one([self.teasers(), f"<h3>{self.one(_PHRASES['aside'])}</h3>" + self.links(2, 6, "aside")]))

    def share(self) -> str:
        return self.within("share", self.one([self.some("share", 2, 5), self.links(2, 5, "share")]))

    def comments(self) -> str:
        tag = self.one(["div", "li", "article", "section"])
        inner = self.one(["", ' class="comment"', ' class="reply"', ' class="c"', ' id="c1"'])
        head = self.one(["", f"<h3>{self.one(_PHRASES['comments'])}</h3>", f"<h2>{self.upto(1, 89)} {self.one(['comments', 'Comments', 'responses', 'Kommentare', 'commentaires'])}</h2>"])
        out = head
        for _ in range(self.upto(1, 6)):
            who, when = self.one(_PHRASES["name"]), self.one([f"{self.upto(1, 28)} May 20{self.upto(10, 25)} at {self.upto(1, 23)}:{self.upto(10, 59)}", f"{self.upto(2, 29)} hours ago", "yesterday", f"20{self.upto(10, 25)}-0{self.upto(1, 9)}-1{self.upto(0, 9)}", ""])
            by = self.one([f"<b>{who}</b> {when}", f"<div>{who}</div><span>{when}</span>", f"<p>{who} {self.one(['says:', 'wrote:', 'on ' + when])}</p>", f"<h4>{who}</h4>", f"<cite>{who}</cite>: "])
            said = self.one([f"<p>{self.sentences(1, 3)}</p>", f"<p>{self.sentences(1, 2)}</p><p>{self.sentences(1, 2)}</p>", f"<div>{self.sentences(1, 3)}</div>", self.sentences(1, 2)])
            out += f"<{tag}{inner}>{by}{said}{self.one(['', self.link(self.one(['Reply', 'Report', 'Antworten', 'Répondre']))])}</{tag}>"
        if tag == "li":
            out = head + "<ol>" + out[len(head) :] + "</ol>"
        out += self.one(["", "", self.signup(), f"<p>{self.one(_PHRASES['comments'])}</p>", "<form><textarea>x</textarea><button>Post</button></form>"])
        if not head and not inner or self.chance(0.7):
            a, b = self.one(["div", "section", "div"]), self.one(_NAMES["comments"])
            return f'<{a} {self.one(["class", "id"])}="{b}">{out}</{a}>'
        return self.within("comments", out)

    def footer(self) -> str:
        said = self.one([f"<p>&copy; 20{self.upto(10, 26)} {self.title()}. {self.one(_PHRASES['footer'])}</p>", f"&copy; {self.words(1, 3)} &middot; {self.sentences(1, 2)}", self.some("footer", 1, 4), f"<p>{self.sentences(1, 3)}</p><p>&copy; {self.title()}</p>"])
        return self.within("footer", self.one(["", self.links(2, 9, "footer")]) + said + self.one(["", self.links(2, 6, "footer")]))

    # The main text.

    def rich(self, text: str) -> str:
        """Some words in inline elements, links among them."""
        if not self.inline or self.chance(0.5):
            return text
        words = text.split(" ")
        for _ in range(self.upto(1, 3)):
            i = self.upto(0, len(words) - 1)
            tag = self.one(["b", "i", "em", "strong", "code", "span", 'a href="/x"', 'a href="https://a.b/c"'])
            if "<" not in words[i]:
                words[i] = f"<{tag}>{words[i]}</{tag.split()[0]}>"
        return " ".join(words)

    def paragraph(self) -> str:
        return f"{MARK}{self.rich(self.sentences(1, 1) if self.chance(0.3) else self.sentences(1, 9))}"

    def piece(self) -> str:
        """A part of the article: mostly paragraphs."""
        way = self.rng.random()
        p = "" if self.chance(0.15) else "</p>"
        if way < 0.64:
            return f"<p>{self.paragraph()}{p}"
        if way < 0.73:
            h = self.one(["h2", "h3", "h4"])
            return f"<{h}>{MARK}{self.title()}</{h}><p>{self.paragraph()}</p>"
        if way < 0.84:
            items = "".join(f"<li>{MARK}{self.one([self.words(1, 2), self.rich(self.words(1, 14)), self.rich(self.words(1, 14)), self.sentences(1, 2)])}{self.one(['</li>', '</li>', ''])}" for _ in range(self.upto(2, 6)))
            return self.one(["<ul>{}</ul>", "<ol>{}</ol>"]).format(items)
        if way < 0.88:
            return f"<blockquote>{self.one(['<p>{}</p>', '{}']).format(self.paragraph())}</blockquote>"
        if way < 0.92:
            return f'<figure><img src="a.png"><figcaption>{MARK}{self.sentences(1, 1)}</figcaption></figure>'
        if way < 0.96:
            rows = "".join("<tr>" + "".join(f"<td>{MARK}{self.words(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(self.upto(2, 5)))
            return f"<table>{rows}</table>"
        if way < 0.98:
            return f"<dl><dt>{MARK}{self.title()}</dt><dd>{self.paragraph()}</dd></dl>"
        return f"<pre>{MARK}{self.words(3, 20)}</pre>"

    def article(self) -> str:
        count = self.one([1, 2, 3, 5, 8, 14, 25])
        if self.chance(0.1):  # no paragraphs, only breaks
            parts = [self.paragraph() + "<br><br>" for _ in range(count)]
        elif self.chance(0.12):
            parts = [f"<div>{self.paragraph()}</div>" for _ in range(count)]
        else:
            parts = [self.piece() for _ in range(count)]
        for _ in range(self.one([0, 0, 0, 1, 2])):
            parts.insert(self.upto(0, len(parts)), self.one([self.advert, self.advert, self.share, self.related, self.signup, self.notice])())
        if self.chance(0.25):
            parts[0] = f"<p><b>{self.paragraph()}<br>" if self.chance(0.5) else parts[0]
        head = self.one(["", f"<h1>{MARK}{self.title()}</h1>", f"<h1>{MARK}{self.words(3, 12)}</h1>", f"<h1>{MARK}{self.words(3, 12)}</h1><h2>{MARK}{self.sentences(1, 1)}</h2>", f"<h2>{MARK}{self.words(3, 12)}</h2>", f"<header><h1>{MARK}{self.words(3, 12)}</h1></header>"])
        by = self.one(["", "", "", f"<p class=\"{self.one(['byline', 'author', 'date', 'meta'])}\">{MARK}By {self.one(_PHRASES['name'])}</p>"])
        tail = self.one(["", "", "", self.share(), self.related(), self.comments()])
        body = head + by + "".join(parts) + tail
        if self.chance(0.3):  # the head outside the container
            return head + self.within("main", body[len(head) :], "div section div td")
        return self.within("main", body, "div section div")


def _escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def compose(seed: int, texts: list[list[str]]) -> str:
    """A page with MARK in all its main blocks. texts: words of each text to write with."""
    rng = random.Random(seed)
    p = _Page(rng, texts)
    if p.chance(0.03):  # main text alone, or none at all
        return p.one([lambda: "".join(f"<p>{p.paragraph()}</p>" for _ in range(4)), p.paragraph, lambda: p.masthead() + p.menu() + p.teasers() + p.footer(), lambda: f"<html><body>{p.article()}</body></html>"])()
    before = [f() for f, often in ((p.notice, 0.3), (p.masthead, 0.6), (p.menu, 0.6), (p.advert, 0.4), (p.sidebar, 0.15)) if p.chance(often)]
    after = [f() for f, often in ((p.share, 0.15), (p.comments, 0.3), (p.related, 0.25), (p.sidebar, 0.3), (p.signup, 0.2), (p.advert, 0.2), (p.footer, 0.85), (p.notice, 0.15)) if p.chance(often)]
    if p.chance(0.3):
        rng.shuffle(before)
    middle = p.article()
    if p.chance(0.15):
        a, b = p.one([("<main>", "</main>"), ('<div id="page">', "</div>"), ('<div class="wrapper">', "</div>"), ("<form>", "</form>")])
        middle = a + middle + (after.pop(0) if after and a != "<main>" else "") + b
    body = "".join(before) + middle + "".join(after)
    if p.chance(0.1):
        body = f"<table><tr><td>{''.join(before)}</td><td>{middle}</td><td>{''.join(after)}</td></tr></table>"
    elif p.chance(0.3):
        body = f'<div class="{p.one(["container", "wrapper", "page", "site", "app"])}">{body}</div>'
    return f"<!DOCTYPE html><html><head><title>{p.title()}</title></head><body>{body}{p.one(['', '</body>', '</body></html>'])}"
