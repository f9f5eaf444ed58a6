"""Pages written by hand after the habits of common publishing systems, none of them made by ``training_pages``.

``data-y`` tells whether what is below an element is main text (1) or not (0); the extractor doesn't read it.
"""

BLOG = """<!doctype html><html lang="en"><head><meta charset="utf-8"><title>Bread at home – Crumbs</title></head>
<body class="post-template single single-post wp-embed-responsive" data-y="0"><div id="page" class="hfeed site">
<a class="skip-link screen-reader-text" href="#c">Skip to content</a>
<header id="masthead" class="site-header"><p class="site-title"><a href="/">Crumbs</a></p><p class="site-description">A kitchen diary</p>
<nav id="site-navigation" class="main-navigation"><ul class="menu"><li class="menu-item"><a href="/r">Recipes</a></li><li class="menu-item"><a href="/a">About</a></li></ul></nav></header>
<div id="content" class="site-content"><main id="main" class="site-main"><article id="post-31" class="post type-post hentry" data-y="1">
<h1 class="entry-title">Bread at home</h1><div class="entry-content"><p>I started with four ingredients and a cold kitchen. The first loaf was a brick, the second a little less so.</p>
<p>Flour matters less than patience: give the dough a night, and it repays you in the morning.</p><figure class="wp-block-image"><img src="l.jpg"><figcaption>The third loaf, still warm.</figcaption></figure>
<h2>What you need</h2><ul><li>500 g of flour</li><li>350 g of water</li><li>10 g of salt</li></ul><p>Mix, wait, fold, wait, bake.</p></div>
<footer class="entry-footer" data-y="0"><span class="cat-links">Posted in <a href="/c">Baking</a></span></footer></article>
<div class="author-bio"><h3>About the author</h3><p>Ida bakes on weekends and writes about it here.</p></div>
<nav class="navigation post-navigation"><a href="/p">Previous post</a> <a href="/n">Next post</a></nav>
<div id="comments" class="comments-area"><h2 class="comments-title">2 thoughts on “Bread at home”</h2><ol class="comment-list"><li class="comment"><p>My loaf came out flat, what did I do wrong?</p></li><li class="comment"><p>Wait longer before you bake it.</p></li></ol></div></main>
<aside id="secondary" class="widget-area"><section class="widget"><h2>Recent posts</h2><ul><li><a href="/1">Soup</a></li><li><a href="/2">Stew</a></li></ul></section></aside></div>
<footer id="colophon" class="site-footer"><div class="site-info">Proudly made at home.</div></footer></div></body></html>"""

NEWS = """<html><head><title>Bridge reopens</title><script>var a = "<p>x</p>";</script></head><body data-y="0">
<div id="gdpr-modal" class="modal"><div class="modal-body"><p>We and our partners store information on your device to measure this site.</p><button>Accept</button></div></div>
<div class="topbar"><div class="topbar-inner"><a href="/">Home</a><a href="/world">World</a><a href="/sport">Sport</a></div></div>
<div class="l-wrap"><div class="story" data-y="1"><h1 class="headline">Bridge reopens after two years</h1><p class="standfirst">Repairs cost more than planned, and the ferry will stop at the end of the month.</p>
<div class="share-bar" data-y="0"><a href="#f">Share</a><a href="#m">Mail</a></div>
<p>The old bridge over the Lune was opened to traffic on Monday, two years after a barge had struck its third pier.</p>
<p>Engineers replaced the pier and strengthened the others. “It will stand for another century,” the head of works said.</p>
<div class="promo-box" data-y="0"><h4>More on this</h4><ul><li><a href="/a">Why the barge was late</a></li><li><a href="/b">The ferry's last summer</a></li></ul></div>
<p>Drivers had taken the detour by the weir, which adds twenty minutes. The town expects shops by the quay to recover.</p>
<blockquote><p>We kept the lights on, but only just.</p></blockquote><p>The ferry made its last planned trip on Sunday night.</p></div>
<div class="rail"><h3 class="rail-title">Most read</h3><ol><li><a href="/1">Storm closes school</a></li><li><a href="/2">Choir wins again</a></li></ol><div class="ad-slot">Advertisement</div></div></div>
<div class="newsletter-signup"><p>Get the morning letter in your inbox.</p><form><input type="email"><button>Sign up</button></form></div>
<div class="footer-links"><a href="/t">Terms</a><a href="/p">Privacy</a><p>© The Quay Courier</p></div></body></html>"""

WIKI = """<html><head><title>Marsh frog</title></head><body class="mediawiki" data-y="0"><div id="mw-page-base"></div>
<div id="content" class="mw-body"><h1 id="firstHeading" data-y="1">Marsh frog</h1><div id="siteSub">From the open encyclopedia</div>
<div id="mw-content-text" data-y="1"><p>The <b>marsh frog</b> is a <a href="/f">frog</a> of ponds and slow rivers. It calls by day and by night, and its call is loud.</p>
<div id="toc" class="toc" data-y="0"><h2>Contents</h2><ul><li><a href="#1">1 Looks</a></li><li><a href="#2">2 Range</a></li></ul></div>
<h2>Looks</h2><p>Adults reach ten centimetres. The back is green or brown, with dark spots and often a pale line along the middle.</p>
<table class="wikitable"><tr><th>Part</th><th>Length</th></tr><tr><td>Body</td><td>about 10 cm</td></tr></table>
<h2>Range</h2><p>It lives from the lowlands in the west to the steppes in the east, wherever water stays through the summer.</p></div>
<div id="catlinks" class="catlinks"><a href="/c">Categories</a>: <a href="/c1">Frogs</a> | <a href="/c2">Wetlands</a></div></div>
<div id="mw-navigation"><div id="p-personal"><ul><li><a href="/l">Log in</a></li></ul></div><div id="p-search"><form><input name="search"></form></div></div>
<div id="footer"><ul id="footer-info"><li>This page was last edited in May.</li><li>Text is available under a free licence.</li></ul></div></body></html>"""

DOCS = """<html><head><title>Install</title></head><body data-y="0"><div class="navbar"><a class="brand" href="/">pipework</a><form class="search"><input placeholder="Search docs"></form></div>
<div class="sidebar"><ul><li><a href="/i">Install</a></li><li><a href="/u">Usage</a></li><li><a href="/r">Reference</a></li></ul></div>
<div class="document"><div class="body" role="main" data-y="1"><h1>Install</h1><p>You need a compiler and a recent shell. Anything from the last five years will do.</p>
<h2>From a package</h2><pre><code>pkg install pipework</code></pre><p>The package holds the program and its manual.</p><h2>From source</h2><p>Unpack the archive, then build it:</p><pre>make
make install</pre>
<dl><dt>PREFIX</dt><dd>The folder to install to.</dd><dt>DEBUG</dt><dd>Set it to build with checks.</dd></dl></div></div>
<div class="prev-next"><a href="/p">Previous: Welcome</a><a href="/n">Next: Usage</a></div><div class="footer">Built with a static generator. Last updated in June.</div></body></html>"""

FORUM = """<html><head><title>Pump loses pressure</title></head><body data-y="0"><div class="header-bar"><a href="/">Fixers</a><a href="/q">Questions</a><a href="/t">Tags</a></div>
<div class="content"><article class="question" data-y="1"><h1>Pump loses pressure after an hour</h1><div class="post-text"><p>My pump starts well, but after an hour the pressure falls to half. I cleaned the filter twice.</p><p>The hose has no leak that I can see. What else can it be?</p></div></article>
<div class="comments"><div class="comment-text">Which pump is it?</div><div class="comment-text">How long is the hose?</div></div></div>
<div class="sidebar"><div class="related"><h4>Related questions</h4><ul><li><a href="/1">Pump is loud</a></li><li><a href="/2">Pump won't start</a></li></ul></div></div>
<footer><p>Fixers helps you to mend things. Contact us.</p></footer></body></html>"""

TABLES = """<html><head><title>Our village</title><body bgcolor=white data-y="0"><table width=100%><tr><td colspan=2><img src=logo.gif> <font size=5>Our village</font></td></tr>
<tr><td width=120 valign=top><a href=index.html>Home</a><br><a href=news.html>News</a><br><a href=map.html>Map</a></td>
<td valign=top data-y="1"><h2>A short history</h2><p>The village was founded by millers, who dammed the brook and built three wheels. Two of them still turn.<p>The church came later, in a year of good harvests. Its tower served as a lookout in the wars.
<p>Since the railway passed us by, little has changed, and most of us like it that way.</td></tr>
<tr><td colspan=2 align=center><small>Page made by the school. Visitors: 01223</small></td></tr></table></body></html>"""

MAGAZINE = """<html><head><title>Night trains</title></head><body data-y="0"><div id="root"><div class="css-1a2b"><div class="css-9z"><a href="/">Along</a><span>Sign in</span><span>Get started</span></div>
<article data-y="1"><div class="css-77"><section><h1>Night trains are back</h1><h2 class="subtitle">And they are slower than ever, which is the point</h2>
<div class="byline" data-y="0"><a href="/@m">Mo Lind</a><span>6 min read</span><button>Follow</button></div>
<p class="css-p1">I boarded in the rain, with a bag of pears and no plan but to sleep. The carriage was older than I am.</p>
<p class="css-p1">By midnight we had crossed two borders, and nobody had asked for a thing. The steward brought tea in glasses.</p>
<p class="css-p1">Slowness has a price. But what you buy with it is a night that belongs to no place, and a morning in another.</p></section></div></article>
<div class="css-tags"><a href="/t1">Travel</a><a href="/t2">Trains</a></div>
<div class="css-author"><h2>Written by Mo Lind</h2><p>Writes about going slowly.</p><button>Follow</button></div>
<div class="css-more"><h2>More from Along</h2><div><a href="/x">The last ferry</a></div><div><a href="/y">A week on foot</a></div></div></div></div></body></html>"""

RECIPE = """<html><head><title>Leek soup</title></head><body data-y="0"><nav class="breadcrumbs"><a href="/">Home</a> &rsaquo; <a href="/s">Soups</a></nav>
<div class="cookie-banner"><p>This site uses cookies. <a href="/c">Learn more</a></p><button>OK</button></div>
<main data-y="1"><h1>Leek soup</h1><p class="summary">A thick soup for cold days, ready in half an hour.</p><div class="rating" data-y="0"><span>4.6</span> <a href="#r">120 ratings</a></div>
<section class="ingredients"><h2>Ingredients</h2><ul><li>3 leeks</li><li>2 potatoes</li><li>1 l of stock</li></ul></section>
<section class="method"><h2>Method</h2><ol><li>Cut the leeks into rings and wash them well.</li><li>Cook them in butter until they are soft, then add potatoes and stock.</li><li>Blend after twenty minutes, and season.</li></ol></section></main>
<aside class="you-may-like"><h3>You may also like</h3><a href="/1">Onion soup</a><a href="/2">Pea soup</a></aside>
<section class="reviews" id="r"><h2>Reviews</h2><div class="review"><p>Made it twice this week, thank you!</p></div></section>
<footer class="page-footer"><p>All recipes are tested in our kitchen.</p><ul><li><a href="/i">Imprint</a></li></ul></footer></body></html>"""

PRESS = """<html><head><title>Town Council</title></head><body data-y="0"><div class="accessibility"><a href="#main">Jump to main content</a></div>
<div class="gov-header"><span class="logo">Town of Ashby</span><ul class="service-nav"><li><a href="/s">Services</a></li><li><a href="/c">Council</a></li></ul></div>
<div class="alert-banner"><p>The town hall is closed on Friday.</p></div>
<div id="main" class="page-content" data-y="1"><h1>Council agrees on the new school</h1><p>At its meeting on Tuesday the council agreed on the site of the new school. Building will begin in spring.</p>
<p>The school will have sixteen rooms, a hall and a garden. It replaces the building in Mill Lane, which is to become a library.</p><p>The plans can be seen at the town hall until the end of the month.</p></div>
<div class="contact-box"><h2>Contact</h2><p>Press office, Market Square 1</p></div><div class="feedback"><form><label>Was this page helpful?</label><button>Yes</button><button>No</button></form></div>
<div class="gov-footer"><a href="/a">Accessibility</a> <a href="/p">Privacy</a></div></body></html>"""

PLAIN = """<p data-y="1">A letter from the coast. The gulls are back, and so is the fog.<p data-y="1">We painted the boat on the first dry day. It took the two of us until dark, and the dog has a blue ear now.
<p data-y="1">Come when you can; the key is where it was."""

LAYOUTS = {"blog": BLOG, "news": NEWS, "wiki": WIKI, "docs": DOCS, "forum": FORUM, "tables": TABLES, "magazine": MAGAZINE, "recipe": RECIPE, "press": PRESS, "plain": PLAIN}
