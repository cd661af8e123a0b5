"""Pages written and labelled by hand: blocks of main text begin with the mark. None comes from the training generator."""

MARK = "¶"
PAGES = {
    "bootstrap": """<body><nav class="navbar navbar-expand"><a class="navbar-brand" href="/">River Notes</a><ul class="navbar-nav"><li><a href="/a">Walks</a></li><li><a href="/b">Maps</a></li></ul></nav>
<div class="container"><div class="row"><div class="col-md-8"><h1>¶Where the river bends</h1><p>¶The path leaves the village by the old mill and follows the water for three miles.</p><p>¶In spring the lower meadow floods, so bring boots and an hour to spare.</p><p>¶Beyond the bridge the valley opens and the hills come into view.</p></div><div class="col-md-4"><h4>Recent walks</h4><ul><li><a href="/1">Castle loop</a></li><li><a href="/2">Moor edge</a></li></ul></div></div></div><footer class="footer"><div class="container"><p>&copy; 2021 River Notes. All rights reserved.</p></div></footer></body>""",
    "wordpress": """<body class="post-template"><div id="page" class="site"><header id="masthead" class="site-header"><p class="site-title"><a href="/">Baking at Altitude</a></p><p class="site-description">Bread from the mountains</p></header><div id="primary" class="content-area"><article class="post hentry"><header class="entry-header"><h1 class="entry-title">¶A slow sourdough</h1><div class="entry-meta">¶Posted on 3 March by Ines</div></header><div class="entry-content"><p>¶Flour behaves differently up here, and so does water.</p><p>¶I let the dough rest overnight in the coldest room of the house.</p><blockquote><p>¶Patience is the only ingredient you cannot buy.</p></blockquote></div></article><div id="comments" class="comments-area"><h2>2 thoughts on this recipe</h2><ol class="comment-list"><li class="comment"><div class="comment-author">Paul says:</div><p>Worked well for me, thanks!</p></li></ol></div></div><aside id="secondary" class="widget-area"><section class="widget widget_archive"><h2>Archives</h2><ul><li><a href="/03">March 2020</a></li></ul></section></aside><footer id="colophon" class="site-footer"><div class="site-info">Proudly powered by a content system</div></footer></div></body>""",
    "headline in header": """<body><nav><a href="/">Front page</a> <a href="/s">Science</a></nav><article><header><h1>¶Bees count to four</h1><p>¶By Lena Ortiz, 12 May</p></header><p>¶Honeybees can tell three dots from four, according to a study published on Tuesday.</p><p>¶The animals were trained with sugar water over several weeks.</p><footer><a href="/t/bees">Share this</a></footer></article><footer>Terms | Privacy | Contact</footer></body>""",
    "list article": """<body><header><a href="/">The Quiet Shelf</a></header><main><h1>¶Seven short novels for a train ride</h1><p>¶All of them can be finished before you arrive.</p><ol><li>¶<a href="/b1">The Lighthouse Keeper's Arithmetic</a></li><li>¶<a href="/b2">A Winter of Small Repairs</a></li><li>¶<a href="/b3">Salt</a></li><li>¶<a href="/b4">Letters to a Cartographer</a></li></ol><p>¶<a href="/more">I wrote about the longer ones last year.</a></p></main><footer><p>About | Contact | RSS</p></footer></body>""",
    "newsletter inside": """<body><header><nav><ul><li><a href="/">Home</a><li><a href="/work">Work</a></ul></nav></header><main><h1>¶The office after six</h1><p>¶When the last lift goes down, the building starts to make noises of its own.</p><div class="newsletter-box"><h3>Get our weekly letter</h3><p>No spam, unsubscribe whenever you like.</p><form><input type="email"><button>Sign up</button></form></div><p>¶The cleaners know all of them by name: the knocking pipe, the humming lamp, the door on the third floor.</p><p>¶Nobody has ever written them down, until now.</p></main><footer>Imprint</footer></body>""",
    "layout table": """<body><table width="100%"><tr><td colspan="2"><font size=5>Model Railway Club</font></td></tr><tr><td width="120"><a href="n.htm">News</a><br><a href="g.htm">Gallery</a><br><a href="j.htm">Join us</a></td><td><h2>¶Building a viaduct in N gauge</h2><p>¶The arches were cut from thin plywood and covered with printed stone paper.</p><p>¶Each pier took an evening, and there are eleven of them.</td></tr></table><p align=center>Copyright 2003 the club</p></body>""",
    "bare": """<h1>¶Notes on tuning a piano</h1><p>¶Start from the A above middle C and work outwards in fifths.<p>¶Listen for beats, not for pitch.<p>¶Expect the treble to drift within a week.""",
    "bare with links on top": """<body><p><a href="index.html">Home</a> | <a href="cv.html">CV</a> | <a href="papers.html">Papers</a></p><h1>¶Why I keep a paper notebook</h1><p>¶Screens remember everything, and that is the trouble with them: I never have to.</p><p>¶A page that can be lost gets read again before it is.</p><hr><p>Last changed 4 June. <a href="mailto:x@y">Mail me</a></p></body>""",
    "boxes without names": """<body><div><div><a href="/">Start</a></div><div><a href="/a">Reisen</a></div><div><a href="/b">Essen</a></div></div><div><div><div><h1>¶Drei Tage am See</h1><div>¶Wir kamen am Abend an, als das Wasser schon dunkel war und die Boote leise aneinander stießen.</div><div>¶Am nächsten Morgen lag Nebel über der Bucht, und man hörte die Glocken vom anderen Ufer.</div></div></div></div><div><div>Impressum</div><div>Datenschutz</div></div></body>""",
    "hashed names": """<body><div class="sc-aXbYc"><div class="sc-kLmNo"><a href="/">Today</a><a href="/m">Markets</a><a href="/t">Tech</a></div></div><div class="sc-pQrSt"><h1 class="sc-uVwXy">¶Copper prices climb for a fifth week</h1><p class="sc-zAbCd">¶Traders pointed to low stocks in warehouses and a strike at a large mine in the north.</p><p class="sc-zAbCd">¶Analysts expect the rally to fade once shipments resume in the autumn.</p></div><div class="sc-eFgHi"><div>More stories</div><a href="/1">Oil slips on weak demand</a><a href="/2">Grain ships leave port</a></div></body>""",
    "documentation": """<body><header class="navbar"><a href="/">libpine</a><input type="search"></header><div class="layout"><aside class="sidebar"><ul class="menu"><li><a href="/i">Introduction</a></li><li><a href="/q">Quick start</a></li><li><a href="/api">API reference</a></li></ul></aside><main class="markdown-body"><h1>¶Quick start</h1><p>¶Install the package and import the reader.</p><pre><code>¶from libpine import Reader
r = Reader("a.pine")</code></pre><h2>¶Reading in parts</h2><p>¶Large files can be read in parts by giving an offset. See <code>Reader.seek</code> for details.</p><table><tr><th>¶Option</th><th>¶Meaning</th></tr><tr><td>¶offset</td><td>¶first byte to read</td></tr></table></main></div><footer class="footer"><a href="/e">Edit this page</a></footer></body>""",
    "cookie first": """<body><div id="cookie-consent" class="banner"><p>We use cookies to give you the best experience.</p><button>Accept all</button><button>Settings</button></div><div class="page"><article class="story"><h1>¶Night trains return</h1><p>¶Sleeper services between the two capitals will run again from December, the operators said.</p><p>¶Tickets go on sale in October.</p></article></div><div class="footer"><span>Contact</span> <span>Jobs</span></div></body>""",
    "figures": """<body><nav>Menu</nav><article><h1>¶The glass roofs of the arcade</h1><figure><img src="a.jpg"><figcaption>¶The north entrance in 1902.</figcaption></figure><p>¶Iron ribs carry more than four thousand panes, none of them quite the same size.</p><div class="ad-slot">Advertisement</div><p>¶Replacing one means measuring it twice.</p></article></body>""",
    "share and related": """<body><main><article><h1>¶A ferry without a captain</h1><div class="share-buttons"><a href="#">Tweet</a><a href="#">Share</a></div><p>¶The vessel crosses the fjord forty times a day, steered by cameras and radar.</p><p>¶Passengers hardly notice; the coffee is the same.</p><section class="related-posts"><h3>Related</h3><ul><li><a href="/x">Robots in the harbour</a></li><li><a href="/y">The last lighthouse keeper</a></li></ul></section></article></main></body>""",
    "definition list": """<body><div class="header">Glossary Online</div><div id="content"><h1>¶Words of the sailmaker</h1><dl><dt>¶Bolt rope<dd>¶The rope sewn to the edge of a sail to strengthen it.<dt>¶Luff<dd>¶The forward edge of a sail.</dl></div><div id="footer">Copyright Glossary Online</div></body>""",
    "comments without names": """<body><article><h1>¶Fixing the gate</h1><p>¶The hinge had rusted through, so I cut it off and welded a new one.</p></article><section><h2>Comments (2)</h2><div><b>mike</b><p>Nice job. What welder do you use?</p><a href="#">Reply</a></div><div><b>sue</b><p>I had the same trouble with mine last winter.</p><a href="#">Reply</a></div></section></body>""",
    "french news": """<body><header role="banner"><a href="/">Le Courrier</a><nav role="navigation"><a href="/p">Politique</a><a href="/c">Culture</a><a href="/s">Sport</a></nav></header><main role="main"><h1>¶Le marché aux livres rouvre ses portes</h1><p class="chapo">¶Après deux ans de travaux, les bouquinistes reviennent sur la place.</p><p>¶Les premiers clients sont arrivés dès l'aube, certains avec des valises vides.</p><p>¶« On retrouve une partie de la ville », dit une habituée.</p></main><footer role="contentinfo"><p>Mentions légales</p><p>Abonnez-vous</p></footer></body>""",
    "russian": """<body><ul class="menu"><li><a href="/">Главная</a></li><li><a href="/n">Новости</a></li></ul><div class="article"><h1>¶Зима в старом городе</h1><p>¶Снег выпал ночью, и к утру улицы стали тихими и белыми.</p><p>¶Дворники вышли раньше обычного, но к полудню всё растаяло.</p></div><div class="footer">Все права защищены</div></body>""",
    "interrupted by advert": """<body><div class="top-ad"><a href="http://buy">Cheap tyres here</a></div><div class="post"><h2>¶Crossing the plateau by bicycle</h2><p>¶The road climbs for nine hours and then simply stops climbing.</p><div class="advert"><p>Special offer: save 20% on tents this week only!</p></div><p>¶From there it is flat to the horizon, with wind from every side.</p><p>¶We slept behind a wall and woke up covered in dust.</p></div><div class="pagination"><a href="/p1">Older</a><a href="/p3">Newer</a></div></body>""",
    "math": """<body><nav><a href="/">Lectures</a></nav><article><h1>¶Areas of circles</h1><p>¶A circle of radius <math><mi>r</mi></math> has the area <math><mi>π</mi><msup><mi>r</mi><mn>2</mn></msup></math>, as shown below.</p><p>¶Double the radius and the area grows four times.</p><noscript><p>¶The figure shows a circle cut into sixteen slices.</p></noscript></article></body>""",
    "forum": """<body><div id="navbar"><a href="/f">Forum index</a> <a href="/r">Register</a> <a href="/l">Login</a></div><div class="post-body"><h1>¶How do I descale a kettle without vinegar?</h1><p>¶Our water is very hard and the kettle is furred after two weeks. I dislike the smell of vinegar, so what else can I use?</p></div><div class="replies comments"><h3>3 replies</h3><div class="reply"><span>tom42 wrote:</span><p>Citric acid, a spoonful in a litre.</p></div><div class="reply"><span>ana wrote:</span><p>Lemon juice works as well.</p></div></div><div id="foot">Powered by boardware</div></body>""",
    "breadcrumb and toc": """<body><ol class="breadcrumb"><li><a href="/">Home</a></li><li><a href="/g">Guides</a></li><li>Compost</li></ol><div class="content"><h1>¶Compost for small gardens</h1><nav class="toc"><p>Contents</p><ul><li><a href="#a">What to add</a></li><li><a href="#b">What to leave out</a></li></ul></nav><h2>¶What to add</h2><p>¶Peel, coffee grounds, leaves and torn cardboard in thin layers.</p><h2>¶What to leave out</h2><p>¶Cooked food draws rats, and citrus slows everything down.</p></div></body>""",
    "sidebar first": """<body><div id="wrapper"><div id="left" class="sidebar"><h3>Categories</h3><ul><li><a href="/c/1">Clocks</a></li><li><a href="/c/2">Radios</a></li></ul><h3>About</h3><p>I repair old things and write about it when the glue is drying.</p></div><div id="right" class="main-column"><h1>¶A radio from 1936</h1><p>¶It came without a back, with a nest of mice where the speaker should be.</p><p>¶The valves were intact, which is more than I can say for the wiring.</p></div></div></body>""",
    "headings and code": """<body><header class="site-header"><span class="logo">devlog</span></header><section class="post"><h1>¶Deleting half the code</h1><p>¶It started with a warning nobody could explain.</p><h3>¶Week one</h3><p>¶We removed every flag that had been on for a year.</p><pre>¶$ git rm -r flags/</pre><h3>¶Week two</h3><ul><li>¶Two services became one.</li><li>¶The build got faster by a third.</li></ul></section><section class="subscribe"><h4>Stay in the loop</h4><form><label>Email</label><input><button>Subscribe</button></form></section></body>""",
    "tabloid": """<body><div class="mega-menu"><ul><li><a>Stars</a></li><li><a>Royals</a></li><li><a>Quiz</a></li></ul></div><div class="article__wrap"><h1 class="article__title">¶Cat elected mayor again</h1><span class="article__date">¶Published 9:14, 2 Nov</span><div class="article__body"><p>¶For the third time running, the small town has chosen a cat to lead it.</p><p>¶The winner slept through the count.</p></div></div><div class="teaser-list"><h2>Read next</h2><div class="teaser"><h3><a href="/d">Dog runs for council</a></h3><p>He promises longer walks for everyone.</p></div><div class="teaser"><h3><a href="/g">Goat blocks motorway</a></h3></div></div><div class="legal">Terms of use</div></body>""",
    "one paragraph": """<body><nav><ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li></ul></nav><article><p>¶The library stays closed on Monday because of the storm.</p></article><footer>&copy; Town of Elm</footer></body>""",
    "spanish": """<body><div id="cabecera"><h2>Diario del Sur</h2><ul><li><a href="/">Inicio</a></li><li><a href="/o">Opinión</a></li></ul></div><div id="contenido"><h1>¶El taller de los relojes</h1><p>¶Don Ramón abre la persiana a las nueve, aunque nadie llega antes de las diez.</p><p>¶Sobre la mesa esperan veinte relojes, cada uno con su propia hora.</p></div><div id="pie"><p>Aviso legal - Contacto - Publicidad</p></div></body>""",
    "unclosed": """<body><nav><a href=/>Home</a><a href=/x>Index</a></nav><div class=content><h1>¶Cheap paper, good ink</h1><p class=it's>¶Don't lose this text.<p>¶It has no closing tags<p>¶and a stray < sign, as in a<b too.</div><div class=footer>All rights reserved</div>""",
    "custom elements": """<body><site-header><a href="/">Kite</a></site-header><app-root><article-view><h1>¶Flying in light wind</h1><p>¶Long lines and a large sail make up for a missing breeze.</p><p>¶Walk backwards, slowly, and let out line in gusts.</p></article-view></app-root><site-footer><p>&copy; Kite club</p></site-footer></body>""",
    "quote and aside": """<body><header><h1>The Evening Review</h1><nav><a href="/b">Books</a><a href="/f">Film</a></nav></header><main><article><h2>¶The house with nine doors</h2><p>¶Her second novel begins where the first one ended, in a kitchen at four in the morning.</p><aside><h3>More by this critic</h3><a href="/q">On reading aloud</a></aside><blockquote>¶Doors are only walls that changed their minds.</blockquote><p>¶It is a book of small rooms and long silences.</p></article></main></body>""",
    "recipe": """<body><div class="topbar"><a href="/login">Log in</a></div><div class="recipe-page"><h1>¶Lentil soup</h1><h2>¶Ingredients</h2><ul><li>¶200 g red lentils</li><li>¶1 onion</li><li>¶2 carrots</li></ul><h2>¶Method</h2><ol><li>¶Soften the onion in oil for ten minutes.</li><li>¶Add the rest with a litre of water and simmer.</li></ol></div><div class="social-links"><a href="#">Pin it</a><a href="#">Print</a></div></body>""",
    "only furniture": """<body><nav><ul><li><a href="/">Home</a></li><li><a href="/shop">Shop</a></li></ul></nav><form class="login-form"><label>Username</label><input><label>Password</label><input><button>Log in</button></form><footer><p>&copy; 2022. All rights reserved.</p></footer></body>""",
    "long press release": """<body><div class="alert">Our offices are closed on Friday.</div><header class="page-head"><nav><a href="/1">Company</a><a href="/2">Careers</a><a href="/3">Investors</a></nav></header><div class="content"><div class="inner"><p>¶Hamburg, 4 April</p><h1>¶New crane enters service at the east terminal</h1><p>¶The crane lifts two containers at once and reaches across twenty-four rows, which makes it the largest in the port.</p><p>¶It was assembled on site over eleven weeks by a crew of sixty.</p><p>¶<strong>Facts</strong></p><ul><li>¶Height: 83 metres</li><li>¶Weight: 1,600 tonnes</li></ul><p>¶Contact for the press: Mara Lind, telephone 555 0100</p></div></div><footer><div class="footer-col"><h5>Company</h5><a href="/a">About</a><a href="/h">History</a></div><p>&copy; Port Authority</p></footer></body>""",
}
