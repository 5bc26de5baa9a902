"""Labelled blocks for the decision tree of ``html.py``: invented pages; blocks of the article end with ``KEPT``."""

KEPT = "✓"

LABELLED_PAGES = [
    # An article between navigation, advert and footer.
    "<html><head><title>Lens care</title></head><body><nav><ul><li><a href=/>Home</a></li><li><a href=/a>Clinics</a></li><li><a href=/b>About us</a></li></ul></nav>"
    "<div class=ad>Save a third on new frames this week only, order today.</div><article><h1>How to care for a lens✓</h1>"
    "<p>Clean the lens with a dry cloth before every session, and keep it in its case.✓</p><p>Done.✓</p><p>Never use water on the coating, it leaves marks that show in every picture.✓</p></article>"
    "<footer>&copy; lens.example all rights reserved</footer></body></html>",
    # Short article, one paragraph, long advert.
    "<body><div class='advert top'>Our partners offer fast tests for the whole family at any time of the day, without waiting, in twenty towns near you, see the list of all places.</div>"
    "<article><p>Closed on Monday.✓</p></article><footer><p>Imprint</p><p>Contact</p></footer></body>",
    # Main element, sidebar and comments.
    "<body><header><a href=/>Eye news</a><p>News about eyes since last year</p></header><main><h1>Results of the field trial✓</h1><p>Four hundred sessions were recorded in spring, most of them with two pictures.✓</p>"
    "<p>See the <a href=/t>table of results</a> for the numbers of each clinic and month.✓</p><h2>Limits✓</h2><p>One site had no second camera, so its pictures come from one side only.✓</p></main>"
    "<aside><h3>Most read</h3><ul><li><a href=/1>Ten exercises</a></li><li><a href=/2>What red means</a></li></ul></aside>"
    "<section id=comments><h3>Two comments</h3><p>I was there in spring and can say that the second camera was broken for weeks, nobody cared.</p><p>Thanks for this.</p></section><footer>Terms Privacy</footer></body>",
    # No article element: plain paragraphs.
    "<body><h1>Notes on pupil size✓</h1><p>The pupil gets smaller in bright light, within a second or less in most people of any age.✓</p><p>In the dark it opens slowly, which is why pictures are taken after a pause of some minutes.✓</p>"
    "<p>Ask first.✓</p><p>A person who has taken drops should not drive home alone, since near things stay blurred for hours.✓</p><div><a href=/p>Previous</a> | <a href=/n>Next</a></div></body>",
    # Divisions only, with names.
    "<body><div id=menu><a href=/>Start</a> <a href=/x>Topics</a> <a href=/y>Shop</a></div><div class=content><div>Pressure in the eye changes through the day and is highest in the morning for many people.✓</div>"
    "<div>Measure it twice.✓</div><div>One value alone says little about the risk, so a second one is taken after noon.✓</div></div><div class='related-links'><a href=/q>More on pressure</a></div><div class=footer>Written for patients. Not advice.</div></body>",
    # Cookie notice and newsletter form.
    "<body><div class=cookie-notice><p>We use cookies to make this page better for you and to count visits. You can say no at any time.</p><button>Accept</button></div>"
    "<article><header><h1>Colour tests at school✓</h1></header><p>Every tenth boy sees red and green in another way, and most learn it in a lesson by chance.✓</p><blockquote><p>I thought all grass was brown.✓</p></blockquote>"
    "<ul><li>Use shapes, not only colours✓</li><li>Write the names of colours on pens✓</li></ul><form><label>Your mail</label><p>Send me one letter a month with all that is new about eyes and schools, I can stop it any time.</p></form></article></body>",
    # A list of links in the article and a share bar.
    "<body><article><h1><a href=/self>Reading at night✓</a></h1><p>Reading with little light tires the eyes, but it does not harm them, say two long studies.✓</p><div class=share><a href=f>Share</a> <a href=t>Send</a></div>"
    "<p>Make pauses, look far away, and blink more often than you think is needed.✓</p><div><a href=/1>Dry eyes</a></div><div><a href=/2>Screens and sleep</a></div><div><a href=/3>Better lamps</a></div></article></body>",
    # Table of contents and breadcrumb, no article element.
    "<body><div class=breadcrumb><a href=/>Home</a> / <a href=/g>Guides</a></div><ul><li><a href=#a>Before</a></li><li><a href=#b>During</a></li><li><a href=#c>After</a></li></ul>"
    "<h2>Before✓</h2><p>Bring your glasses and a list of all the medicine you take, with doses and times.✓</p><h2>During✓</h2><p>You look at a green point while the camera moves; the flash is short and does no harm.✓</p>"
    "<h2>After✓</h2><p>Results come within two weeks by post, with a copy for your doctor if you agree.✓</p><p><a href=/all>All guides</a></p><p>Legal</p></body>",
    # A page of links only.
    "<body><h1>Index</h1><ul><li><a href=/1>January</a></li><li><a href=/2>February</a></li><li><a href=/3>March</a></li><li><a href=/4>April</a></li></ul><p><a href=/old>Older years</a></p></body>",
    # Login form and advert between paragraphs of an article.
    "<body><nav><a href=/>Start</a></nav><form><label>Name</label><input><label>Password</label></form><article><p>Glaucoma takes sight from the edge inward, so it is noticed late by most who have it.✓</p>"
    "<div class='ad-slot'>Try the new drops now, half price for members and their friends.</div><p>Yes.✓</p><p>A test of the visual field shows gaps long before they matter in daily life.✓</p><p><b>Ask for the test at fifty.✓</b></p></article>"
    "<div id=footer><p>This page was made with care by a small team in the north of the country since many years.</p></div></body>",
    # Notice and popup around a long article, unclosed paragraphs.
    "<body><div role=alert>Site works tonight from ten, some pages may be slow or missing for an hour.</div><article><h1>Night vision✓</h1><p>Rods need half an hour to reach their full strength.✓<p>Red light spares them.✓<p>Sailors used it on deck for that reason, and pilots too until screens came.✓</article>"
    "<div class=popup>Stay in touch, join the list.</div><footer><ul><li><a href=/i>Imprint</a></li><li><a href=/d>Data</a></li></ul></footer></body>",
    # Plain text page without furniture.
    "<p>Only one paragraph with a few sentences stands here. It has no menu and no footer at all.✓</p>",
    # Links inside running text.
    "<body><div><p>The <a href=/a>atlas of the retina</a> shows forty cases, each with <a href=/b>two pictures</a> and a <a href=/c>short note</a> on how they were found and treated.✓</p>"
    "<p>It is free for schools and clinics that send their own pictures in return, without names.✓</p></div><div><a href=/d>Order</a> <a href=/e>Help</a></div><div>All prices with tax</div></body>",
    # Reader comments in a list after the article.
    "<body><article><p>Drops sting less when they are cold, so keep the bottle in the door of the fridge.✓</p><p>Shake it.✓</p></article><div class='comment-list'><div class=comment>Cold drops helped my mother a lot, many thanks for the hint from all of us here.</div>"
    "<div class=comment>Same.</div><div class=comment>I keep mine at work, where the fridge is always full of other things.</div></div></body>",
    # Two plain blocks, and one short note, without any mark-up around them.
    "<div>The first picture of a session is taken without flash, so that the pupil stays as wide as it is.✓</div><div>Then the flash is used for all the others, from the centre to the edge.✓</div>",
    "<body><p>A short note of nine words stands here alone.✓</p></body>",
    "<body><article><h1>Marks✓</h1><p>Small.✓</p></article></body>",
    "<body><nav><a href=/>Start</a></nav><article><p>No.✓</p><p>Nothing was found in the left eye, and nothing in the right one, at either visit.✓</p><p>See <a href=/x>here</a>.✓</p></article><footer>2020</footer></body>",
    # Wrappers that name their sidebar, around an article element and around plain divisions.
    "<body class=content-sidebar><div class='page-with-sidebar'><div class='content-sidebar-wrap'><main><article><h1>Frames for children✓</h1><p>A frame must sit on the nose without a gap, or it slides down when the child runs.✓</p>"
    "<p>Try it on.✓</p></article></main><aside class='sidebar sidebar-primary'><p>Our shop has new frames for all ages, in nine colours, come and see them on any day of the week.</p></aside></div></div></body>",
    "<body><div class='content-sidebar-wrap'><div><p>The optic nerve has about a million fibres, and they do not grow again once they are lost.✓</p><p>So time counts.✓</p>"
    "<p>A doctor looks at the head of the nerve with a lens and notes how deep the cup is.✓</p></div><div class=sidebar-widget>Get the app for your phone and read all our pages on the train or at home.</div></div></body>",
    # Sections whose ids are subjects, in an article and without one.
    "<body><article><h1>Trial of two lenses✓</h1><section id=methods><p>We took two pictures of each eye, an hour apart, in the same room and light.✓</p></section>"
    "<section id=discussion><h2>Discussion✓</h2><p>The second lens was better in dim light, which agrees with two older trials in the north.✓</p><p>Costs differ.✓</p></section>"
    "<section id=commentary class=commentary><p>An editor adds that both lenses have been sold for years without any harm.✓</p></section>"
    "<section class=legal><p>The law of each country says who may fit them and who may not.✓</p></section></article><div class=comments><p>I have worn the first one since spring, and I would not change it for any other.</p></div></body>",
    "<body><div id=intro><p>Squint in small children is seen best when they look at a light from some distance.✓</p></div><div id=search><h2>Search✓</h2><p>We read all reports since the year ninety and kept those with twenty children or more.✓</p></div>"
    "<div id=discussion><p>Early care helps, since the brain learns to use both eyes only in the first years.✓</p><p>Late care helps less.✓</p></div></body>",
    # Labels that may be subjects, on furniture.
    "<body><div class=search><a href=/s>Search</a></div><div class=content><p>Tears have three layers, of oil, water and slime, and all three are needed for a clear view.✓</p></div><div class=legal><a href=/l>Legal</a> <a href=/p>Privacy</a></div></body>",
]
