"""Pages whose main text is marked, from which the weights of html.Model are learned. All of them are invented."""

PAGES = [
    # a news page with article, sidebar, advert, share bar and reader comments
    """<!doctype html><html><head><title>Harbour opens</title><style>p{margin:0}</style></head><body>
<header><div class="logo"><a href="/">The Daily Tide</a></div><nav class="menu"><ul><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li><li><a href="/w">Weather</a></li></ul></nav></header>
<div class="cookie-notice">We use cookies to make this site work well for you. <button>Accept</button></div>
<div class="ad">Buy new boots today at half the price, only this week in all our shops.</div>
<article><!--main--><h1>The harbour opens again after a long winter</h1><p>The first boats left the harbour on Monday morning, after three months in which ice had kept them at the quay.</p>
<p>The master of the port said that he had <em>never</em> seen such a winter, and that the crews had been <a href="/x">waiting</a> for weeks.</p><!--/main-->
<div class="ad">Sponsored: the best insurance for your car, compare more than forty offers now.</div>
<!--main--><p>Fish will be sold at the market from Wednesday on, at the prices of last year.</p><!--/main-->
<div class="share"><a href="#">Share</a> <a href="#">Tweet</a></div></article>
<aside class="sidebar"><h3>Most read</h3><ul><li><a href="/1">Storm over the bay</a></li><li><a href="/2">New bridge planned</a></li></ul><p>Sign up for our weekly letter and never miss a story again.</p></aside>
<section id="comments" class="comments"><h3>Comments</h3><div class="comment"><p>I was there and it was a lovely morning, thank you for the report.</p></div><div class="comment"><p>About time that they opened it, we waited for far too long.</p></div>
<form class="reply"><label>Your comment</label><textarea></textarea><input type="submit" value="Send"></form></section>
<footer><p>Copyright The Daily Tide. All rights reserved. <a href="/i">Imprint</a> <a href="/p">Privacy</a></p></footer><script>track("<p>no</p>");</script></body></html>""",
    # a blog built of plain divs
    """<html><head><title>On bread</title></head><body><div id="wrapper"><div id="header"><h2>My kitchen notes</h2><div id="navigation"><a href="/">Home</a> | <a href="/about">About</a> | <a href="/archive">Archive</a></div></div>
<div id="content"><div class="post"><!--main--><h2>How I bake bread</h2><p>I mix the flour with water in the evening and leave the bowl on the table until the next day.</p><p>In the morning the dough has doubled. I fold it four times, shape it and let it rest for two more hours.</p><ul><li>500 grams of flour</li><li>350 grams of water</li><li>10 grams of salt</li></ul><p>The oven should be as hot as it can be.</p><!--/main--></div>
<div class="related"><h4>You may also like</h4><ul><li><a href="/a">Soup for cold days</a></li><li><a href="/b">What to do with old bread</a></li></ul></div>
<div id="respond"><h4>3 replies</h4><p class="comment">Mine came out flat, what did I do wrong?</p><p class="comment">Try it with less water, that helped me a lot.</p></div></div>
<div id="sidebar"><h3>About me</h3><p>I am a cook from the north and I write about simple food.</p><h3>Archive</h3><ul><li><a>May</a></li><li><a>June</a></li></ul></div><div id="footer">Powered by nothing at all. Theme by a friend.</div></div></body></html>""",
    # main element, breadcrumb, newsletter, unclosed paragraphs
    """<!DOCTYPE html><html><body><nav role="navigation"><a href="/">Start</a><a href="/shop">Shop</a><a href="/help">Help</a></nav><ol class="breadcrumb"><li><a href="/">Start</a></li><li>Help</li></ol>
<main role="main"><!--main--><h1>How to return a parcel</h1><p>Put the goods back into the box in which they came and close it well.<p>Write the number of your order on the label, and bring the box to any post office within thirty days.<br>You will get a receipt there; please keep it until the money has arrived.<p>It takes about a week.<!--/main--></main>
<div class="newsletter"><p>Get ten percent off your next order when you subscribe to our newsletter.</p><form><input name="mail"><button>Subscribe</button></form></div><footer><ul><li><a href="/t">Terms</a></li><li><a href="/j">Jobs</a></li></ul><p>&copy; 2020 A shop. Prices include tax.</p></footer></body></html>""",
    # bare body, no useful names at all
    """<html><body><!--main--><h1>Notes on the old mill</h1><p>The mill stands at the end of the village, where the brook leaves the wood and the road turns to the hills.</p><p>It was built by two brothers, and it ground the corn of nine farms for more than a hundred years.</p><p>Today it is a museum. It is open on Sundays.</p><!--/main--><hr><a href="a.html">Back</a> <a href="b.html">Next</a></body></html>""",
    # advert before, footer line after, small article
    """<html lang="en"><head><meta charset="utf-8"><title>Rain</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">a</a></li><li><a href="/b">b</a></li><li><a href="/c">c</a></li></ul></nav><!-- ad --><div class="ad">A short line that somebody paid for.</div><article><!--main--><h1>Rain</h1><p>It rained.</p><!--/main--></article><footer>&copy; example.org &middot; Another line of words that goes on for a while. And one more.</footer></body></html>""",
    """<html lang="de"><head><title>Regen</title></head><body><nav><ul><li><a href="/a">der</a></li><li><a href="/b">die</a></li></ul></nav><div class="ad">Jetzt neu und nur hier.</div><article><!--main--><h1>Regen</h1><p>Es hat den ganzen Tag geregnet, und am Abend standen die Wiesen unter Wasser.</p><p>Niemand ging aus dem Haus.</p><!--/main--></article><footer>&copy; example.org &middot; Und noch eine Zeile, die zu lang ist, um sie zu lesen. Und mehr.</footer></body></html>""",
    # documentation with a table of contents and code
    """<html><body><div class="topbar"><a href="/">Docs</a> <form class="search"><input></form></div><div class="sidebar"><ul class="menu"><li><a href="#1">Install</a></li><li><a href="#2">Use</a></li><li><a href="#3">Change</a></li></ul></div>
<div class="body" role="main"><!--main--><h1>Install</h1><p>Get the archive and unpack it into a folder of its own.</p><pre>tar xf tool.tar
cd tool</pre><h2>Use</h2><p>Call the tool with the name of a file. It prints one line for each record that it finds.</p><table><tr><th>Option</th><th>Meaning</th></tr><tr><td>-v</td><td>say more</td></tr></table><!--/main--></div>
<div class="footer"><p>Last changed in May. Found a mistake? <a href="/e">Edit this page</a>.</p></div></body></html>""",
    # a story page with pop-up, promotion between paragraphs and a long comment thread
    """<html><body><div class="popup modal"><p>Do not leave yet! Join forty thousand readers and get our stories by mail.</p><button>Join</button></div><div class="masthead"><a href="/">Field and River</a></div><div class="story"><!--main--><h1>The last ferry</h1><p>When the bridge was finished nobody needed the ferry any more, and the ferryman sold his boat to a painter from the city.</p><!--/main--><div class="promo"><p>Read the whole series in our printed edition, now in every shop.</p></div><!--main--><p>The painter lived on it for nine summers. In the tenth she took it down the river to the sea.</p><blockquote>I never learned to steer it, she said.</blockquote><p>Nobody knows where it is today.</p><!--/main--></div><div class="social"><a>Like</a><a>Share</a></div>
<div class="discussion"><h3>Discussion</h3><div class="reply"><b>Ann</b><p>My grandfather was that ferryman, and he often spoke about the day on which he sold the boat.</p></div><div class="reply"><b>Bo</b><p>What a fine story. I have been on that boat as a child and I still remember the smell of paint and tar.</p></div><div class="reply"><b>Cy</b><p>Is there a picture of it?</p></div></div><div class="legal">All texts belong to their writers. Do not copy without asking.</div></body></html>""",
    # login form and notices above the text
    """<html><body><header><h1><a href="/">Town council</a></h1><form class="login"><label>Name</label><input><label>Password</label><input><button>Log in</button></form></header><div class="alert notice"><p>The office is closed on Friday because of the holiday.</p></div><section class="content"><article class="entry"><!--main--><h2>New opening times of the library</h2><p>From the first of March the library opens at nine in the morning on every day but Sunday.</p><p>Books can also be brought back at night, through the box beside the door.</p><!--/main--></article></section><aside><p>Do you need help? Call us between eight and twelve.</p></aside><footer><nav><a>Contact</a><a>Map</a></nav><p>Town council, Market 1</p></footer></body></html>""",
    # entry with tags, pager and widget
    """<html><body><ul class="nav"><li><a>One</a><li><a>Two</a><li><a>Three</a></ul><div class="main"><div class="entry"><!--main--><h1>Three days on foot</h1><p><b>Day one.</b> We left at six and walked along the ridge until noon, with the lake on our left.<br>In the evening it snowed.</p><p><i>Day two.</i> We stayed in the hut.</p><p>Day three. The way down was long, and our feet were wet, but the sun came out.</p><!--/main--><div class="tags"><a>walking</a> <a>snow</a></div><div class="pagination"><a>Older</a> <a>Newer</a></div></div><div class="widget"><h4>Weather</h4><p>Four degrees and cloudy, rain in the evening.</p></div><div class="widget banner"><p>Huts for rent, all year round, call now.</p></div></div><div class="copyright">Written by us.</div></body></html>""",
    # header inside the article, figures and captions
    """<html><body><div role="banner"><a>Science weekly</a></div><div role="navigation"><a>Space</a><a>Earth</a><a>Life</a></div><main><article><!--main--><h1>Why leaves turn red</h1><p>In autumn trees take back what they can use from their leaves.</p><figure><img src="a.png"><figcaption>A maple in October.</figcaption></figure><p>What is left is yellow, and some kinds make a red colour that protects the leaf from light.</p><!--/main--></article></main><div class="recommended"><h3>Recommended</h3><p><a>Why the sky is blue</a></p><p><a>How bees find home</a></p></div><div role="complementary"><p>Our new book is out now. It has two hundred pages and many pictures.</p></div><div role="contentinfo"><p>Science weekly is made by volunteers.</p></div></body></html>""",
    # text before any name, nested tables
    """<html><body><table><tr><td class="menu"><a>Start</a><br><a>Pictures</a><br><a>Guests</a></td><td class="text"><!--main--><h1>Our village band</h1><p>We are eleven people who play on Thursdays in the old school. Anyone who can hold a horn is welcome.</p><p>In summer we play at weddings and at the fair, and once a year in the church.</p><!--/main--></td></tr><tr><td colspan="2" class="footer">You are visitor number 3021. Made with love and a text editor.</td></tr></table></body></html>""",
    # no names that mean anything
    """<html><body><div><a href="/">x</a> <a href="/y">y</a></div><div><div><!--main--><p>The road to the coast is closed between the two bridges until the end of the month, because the river has washed out the bank.</p><p>Drivers should take the road over the hills, which is longer but dry.</p><!--/main--></div></div><div>2019</div></body></html>""",
    """<html><body><div class="x1"><span>a</span><span>b</span></div><div class="x2"><!--main--><h2>What the tide brings</h2><p>After a storm the beach is full of things that nobody has lost: shells, ropes, a door, a green glass ball.</p><p>We collect them and put them on the wall.</p><p>Some say that the wall is art. We say that it is a wall.</p><!--/main--></div><div class="x3"><a>up</a></div></body></html>""",
    """<p><!--main-->The bell rings at seven, and by eight the whole street is awake and on its way to the market.</p><p>By noon it is quiet again.<!--/main--></p>""",
]
