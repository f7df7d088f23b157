"""The rule tables. Everything below is fixed values: the results depend on them to the letter.

A rule is a line of fields parted by " ~ "; patterns are written with ASCII word edges (see js_regex).
"""

from __future__ import annotations

# Fixed values from here on.

# Marketing angles: key ~ label ~ description, then key ~ weight ~ pattern.
ANGLES = r"""
problem-agitation ~ Problem / agitation ~ Names the pain and turns up the heat before offering relief.
mechanism ~ Unique mechanism ~ Explains the specific "how" that makes the product work — the classic differentiator.
authority-science ~ Authority / science ~ Borrows credibility from experts, studies, labs or certifications.
social-proof ~ Social proof ~ Leans on crowds, ratings and testimonials to de-risk the purchase.
transformation ~ Transformation / before-after ~ Sells the visible change and the timeline to get it.
founder-story ~ Founder / origin story ~ Uses a personal origin narrative to build trust and differentiation.
us-vs-them ~ Us vs. them ~ Positions against an enemy — competitors, the old way, or an industry.
curiosity ~ Curiosity / open loop ~ Withholds the payoff to buy the click.
urgency-scarcity ~ Urgency / scarcity ~ Compresses the decision window with deadlines or stock limits.
offer-value ~ Offer / price-value ~ Leads with the deal rather than the product.
risk-reversal ~ Risk reversal / guarantee ~ Removes the downside of trying.
identity ~ Identity / tribal call-out ~ Speaks to a specific self-image so the right reader self-selects.
fear-warning ~ Fear / warning ~ Frames inaction as the dangerous choice.
convenience ~ Convenience / simplicity ~ Sells the absence of effort.
clean-natural ~ Clean / natural ingredients ~ Differentiates on what is NOT in the product.
aspiration ~ Aspiration / status ~ Sells the identity upgrade rather than the function.
objection-handling ~ Objection handling ~ Pre-empts the reason the reader would say no.
seasonal-event ~ Seasonal / event hook ~ Attaches the offer to a date on the reader's calendar.
ingredient-hero ~ Hero ingredient ~ Leads with one named ingredient as the reason to believe.
ugc-testimonial ~ Customer voice / UGC ~ Written as a customer speaking, not a brand broadcasting.
"""

ANGLE_PATTERNS = r"""
problem-agitation ~ 3 ~ \b(tired of|sick of|fed up with|struggling with|suffering from)\b
problem-agitation ~ 2 ~ \b(embarrassed|frustrated|exhausted|miserable|hopeless)\b
problem-agitation ~ 2 ~ \b(stop (losing|wasting|suffering)|no longer have to)\b
problem-agitation ~ 1.5 ~ \b(hate|dread|can'?t stand)\b
problem-agitation ~ 2 ~ \bif you'?re (still|constantly|always)\b
problem-agitation ~ 0.6 ~ \b(problem|issue|struggle)\b
mechanism ~ 3 ~ \b(works by|mechanism|targets the (root|underlying)|patented|proprietary)\b
mechanism ~ 3 ~ \b(clinically (formulated|dosed)|bioavailab\w+|absorption rate|time.?release)\b
mechanism ~ 2.5 ~ \b(the (real|actual|root) cause)\b
mechanism ~ 1 ~ \b(formula|formulated with|blend of)\b
mechanism ~ 3 ~ \bhere'?s how it works\b
authority-science ~ 3 ~ \b(clinically (proven|tested|studied)|peer.?reviewed|double.?blind|placebo)\b
authority-science ~ 2.5 ~ \b(doctor|physician|dermatologist|nutritionist|phd|md|scientist|researcher)s?\b
authority-science ~ 3 ~ \b(studies show|research shows|according to (a )?study|published in)\b
authority-science ~ 2.5 ~ \b(third.?party tested|gmp|nsf certified|fda.?(registered|approved)|lab.?tested)\b
authority-science ~ 3 ~ \b(harvard|stanford|mayo clinic|nih|journal of)\b
social-proof ~ 3 ~ \b(\d[\d,.]*\+?\s*(k|m|million|thousand)?\s*(customers|reviews|people|users|members|sold))\b
social-proof ~ 3 ~ \b(join (over |more than )?\d|trusted by|loved by)\b
social-proof ~ 2.5 ~ \b(5.?star|four point|4\.\d\s*(/|out of)\s*5|rated \d)\b
social-proof ~ 2 ~ \b(best.?sell(er|ing)|viral|sold out|waitlist)\b
social-proof ~ 2.5 ~ \b(testimonial|real (customers|reviews)|verified (buyer|review))\b
transformation ~ 3 ~ \b(before and after|before / after|my results|the results)\b
transformation ~ 2.5 ~ \b(in (as little as )?\d+ (days|weeks|months))\b
transformation ~ 3 ~ \b(went from .{0,30} to)\b
transformation ~ 2 ~ \b(transform\w*|life.?changing|night and day)\b
transformation ~ 3 ~ \b(lost \d+ ?(lbs|pounds|kg)|dropped \d+)\b
founder-story ~ 3 ~ \b(our founder|i (started|created|built|founded)|we started)\b
founder-story ~ 2.5 ~ \b(after (years|months|decades) of)\b
founder-story ~ 3 ~ \b(so i (made|built|created)|that'?s why (i|we) (made|built|created))\b
founder-story ~ 2 ~ \b(family.?(owned|run)|our story)\b
us-vs-them ~ 3 ~ \b(unlike (other|most|the)|most (brands|companies|products))\b
us-vs-them ~ 3 ~ \b(big (pharma|supplement|beauty|food)|the industry (doesn'?t|won'?t))\b
us-vs-them ~ 3 ~ \b(what (they|companies) don'?t want you to know)\b
us-vs-them ~ 2.5 ~ \b(no more (overpriced|watered.?down)|stop (paying|overpaying))\b
us-vs-them ~ 1 ~ \b(compared to|versus|vs\.?)\b
curiosity ~ 3 ~ \b(the (real|surprising|weird|one) (reason|thing|trick))\b
curiosity ~ 3 ~ \b(nobody (tells|talks about)|no one (tells|warns))\b
curiosity ~ 2 ~ \b(here'?s why|this is why|turns out)\b
curiosity ~ 2 ~ \b(secret|little.?known|hidden|shocking)\b
curiosity ~ 3 ~ \b(you'?(ll|re) never guess|what happened next)\b
urgency-scarcity ~ 3 ~ \b(ends (today|tonight|soon)|last chance|final (hours|day))\b
urgency-scarcity ~ 3 ~ \b(selling out|almost gone|limited (stock|quantity|time|edition)|while supplies last)\b
urgency-scarcity ~ 3 ~ \b(only \d+ left|back in stock|restock)\b
urgency-scarcity ~ 2.5 ~ \b(hurry|don'?t miss|act now|today only)\b
offer-value ~ 3 ~ \b(\d{1,2}% off|save \$?\d+|\$\d+ off)\b
offer-value ~ 3 ~ \b(buy one get one|bogo|free (shipping|gift|bottle|trial))\b
offer-value ~ 2 ~ \b(bundle|subscribe (and|&) save|starter kit)\b
offer-value ~ 2.5 ~ \b(cheaper than|less than (a|the) (cup of )?coffee|per day)\b
offer-value ~ 1.5 ~ \b(discount|deal|promo code|coupon)\b
risk-reversal ~ 3 ~ \b(money.?back|refund|risk.?free|no questions asked)\b
risk-reversal ~ 3 ~ \b(\d+.?(day|night) (guarantee|trial|promise))\b
risk-reversal ~ 2.5 ~ \b(cancel any ?time|free returns|satisfaction guaranteed)\b
risk-reversal ~ 2.5 ~ \b(if you don'?t (love|see))\b
identity ~ 3 ~ \b(for (men|women|moms|dads|guys|girls|athletes|lifters|runners|nurses|teachers) (who|over))\b
identity ~ 3 ~ \b(attention |calling all )\b
identity ~ 2.5 ~ \b(if you'?re a \w+)\b
identity ~ 3 ~ \b(men over \d+|women over \d+|\d+\+ (men|women))\b
identity ~ 2.5 ~ \b(built for|made for|designed for) (men|women|athletes|professionals)\b
fear-warning ~ 3 ~ \b(warning|beware|danger\w*|toxic|harmful)\b
fear-warning ~ 2.5 ~ \b(stop (using|taking|doing)|throw away your)\b
fear-warning ~ 3 ~ \b(could be (damaging|destroying|killing)|is ruining)\b
fear-warning ~ 2.5 ~ \b(side effects|linked to (cancer|disease))\b
fear-warning ~ 3 ~ \b(before it'?s too late|don'?t wait until)\b
convenience ~ 3 ~ \b(in (just |under )?\d+ (seconds|minutes)|takes \d+ seconds)\b
convenience ~ 3 ~ \b(one (scoop|pill|step|tap)|just add water|no (mixing|mess|prep))\b
convenience ~ 2.5 ~ \b(effortless|hassle.?free|no more (guessing|counting))\b
convenience ~ 2 ~ \b(delivered to your door|auto.?ship|on your schedule)\b
clean-natural ~ 3 ~ \b(no (fillers|artificial|synthetic|sugar|gluten|parabens|sulfates|seed oils))\b
clean-natural ~ 3 ~ \b(clean (ingredients|label|beauty)|non.?toxic|free from)\b
clean-natural ~ 1.5 ~ \b(organic|all.?natural|plant.?based|vegan|cruelty.?free)\b
clean-natural ~ 3 ~ \b(only \d+ ingredients|\d+ simple ingredients)\b
aspiration ~ 3 ~ \b(look (younger|leaner|better)|feel (confident|unstoppable|amazing))\b
aspiration ~ 3 ~ \b(turn heads|people will ask|compliments)\b
aspiration ~ 2.5 ~ \b(best version of (yourself|you)|level up|upgrade your)\b
aspiration ~ 1.5 ~ \b(luxury|premium|elevated|indulg\w+)\b
objection-handling ~ 3 ~ \b(you (might|may) be thinking|i know what you'?re thinking)\b
objection-handling ~ 3 ~ \b(but does it (actually |really )?work|is it worth it)\b
objection-handling ~ 3 ~ \b(too good to be true|i was sceptical|i was skeptical|didn'?t believe)\b
objection-handling ~ 2 ~ \b(no, (it|this) (isn'?t|is not))\b
seasonal-event ~ 3 ~ \b(black friday|cyber monday|christmas|holiday|new year|valentine)\b
seasonal-event ~ 3 ~ \b(summer body|back to school|spring clean|resolution)\b
seasonal-event ~ 3 ~ \b(mother'?s day|father'?s day|prime day)\b
ingredient-hero ~ 3 ~ \b(\d+\s?mg of)\b
ingredient-hero ~ 3 ~ \b(clinical dose|full dose|standardi[sz]ed extract)\b
ingredient-hero ~ 2 ~ \b(powered by|infused with|packed with) \w+
ingredient-hero ~ 1.5 ~ \b(retinol|niacinamide|hyaluronic|creatine|ashwagandha|magnesium|collagen|peptide)s?\b
ugc-testimonial ~ 3 ~ \b(i'?ve been using|i started (taking|using)|my (skin|hair|energy|sleep|doctor))\b
ugc-testimonial ~ 2 ~ \b(honestly|ngl|not gonna lie|obsessed|literally)\b
ugc-testimonial ~ 3 ~ \b(i was (sceptical|skeptical|shocked|amazed))\b
ugc-testimonial ~ 2.5 ~ \b(would recommend|10/10|game.?changer)\b
"""

# Emotions: name ~ pattern.
EMOTIONS = r"""
frustration ~ \b(frustrat\w+|annoying|tired of|sick of|fed up|struggle)\b
fear ~ \b(afraid|scary|dangerous|risk|warning|damage|irreversible)\b
hope ~ \b(finally|at last|hope|there is a way|it is possible)\b
embarrassment ~ \b(embarrass\w+|ashamed|awkward|self.?conscious|hide)\b
pride ~ \b(proud|confidence|confident|earn|deserve|achievement)\b
belonging ~ \b(join|community|thousands of (people|men|women)|you'?re not alone)\b
relief ~ \b(relief|relax|calm|finally sleep|no more pain|ease)\b
desire ~ \b(crave|want|dream|glow|irresistible|delicious)\b
curiosity ~ \b(secret|surprising|weird|why|what if|turns out)\b
anger ~ \b(scam|rip.?off|lie|lied|fraud|outrage\w*)\b
trust ~ \b(guarantee|certified|transparent|honest|no hidden)\b
urgency ~ \b(now|today|hurry|don'?t wait|deadline|last chance)\b
"""

OFFERS = r"""
discount-percent ~ \b(\d{1,2})\s?% ?(off|discount|savings)\b
discount-amount ~ \b(save\s)?[$£€]\s?\d+(\.\d{2})?\s?(off|discount)?\b
bogo ~ \b(buy one,? get one|bogo|2 for 1|b1g1)\b
free-shipping ~ \bfree (shipping|delivery|returns)\b
free-trial ~ \b(free (trial|sample)|try (it )?free)\b
subscription ~ \b(subscribe (and|&) save|subscription|auto.?ship|monthly delivery|cancel any ?time)\b
bundle ~ \b(bundle|starter (kit|pack)|value pack|\d+.?pack)\b
guarantee ~ \b(\d+.?day (money.?back|guarantee)|money.?back guarantee|risk.?free)\b
gift ~ \b(free (gift|bottle|gift with purchase)|gift with)\b
limited-time ~ \b(limited time|today only|ends (today|tonight|soon)|while supplies last|last chance)\b
"""

AWARENESS = r"""
most-aware ~ 3 ~ \b(order now|shop now|get yours|buy now|use code|checkout|restock(ed)?|back in stock)\b
most-aware ~ 2 ~ \b(\d{1,2}% off|free shipping|today only|last chance)\b
product-aware ~ 2.5 ~ \b(unlike (other|most)|compared to|vs\.?|why (we|ours)|reviews|rated|guarantee|money.?back)\b
product-aware ~ 2 ~ \b(our (formula|product|serum|blend)|we (made|built|created))\b
solution-aware ~ 2.5 ~ \b(how it works|works by|clinically (proven|dosed)|mechanism|ingredient|\d+\s?mg|the (best|right) (way|type) to)\b
problem-aware ~ 3 ~ \b(tired of|struggling with|sick of|if you'?re (still|always)|do you (have|suffer|struggle)|symptoms?)\b
problem-aware ~ 2 ~ \b(bloating|brain fog|hair loss|acne|can'?t sleep|low energy|joint pain)\b
unaware ~ 3 ~ \b(i (never|used to)|it started when|nobody (tells|talks)|turns out|the real reason|most people don'?t know)\b
"""

HOOKS = r"""
question ~  ~ \?\s*$
call-out ~ i ~ ^(attention|calling all|hey |psa|to (all|every) )
statistic ~  ~ \b\d{1,3}\s?%|\b\d[\d,]{2,}\b
warning ~ i ~ ^(warning|stop|don'?t|never|beware|read this before)
command ~ i ~ ^(try|get|meet|discover|start|switch|ditch|throw out|say goodbye)
curiosity-gap ~ i ~ ^(the (real|one|weird|surprising)|this is (why|what|how)|nobody|turns out|here'?s (why|what|how))
first-person-story ~ i ~ ^(i |my |we |after (years|months)|\d+ (years|months) ago)
comparison ~ i ~ ^(unlike|most (people|brands|men|women)|everyone (thinks|says))
relatable-pain ~ i ~ ^(if you|when you|ever (felt|had|woken))
offer-led ~ i ~ ^(\d{1,2}% off|save|free |buy one|limited time|today only)
"""

FUNNELS = r"""
quiz ~ /(quiz|assessment|find-?your|match|consultation|diagnos)
advertorial ~ /(blogs?|articles?|story|stories|read|learn|news|advertorial|why-|how-|the-truth)
listicle ~ /(top-?\d|best-?\d|\d+-(reasons|ways|things|signs|mistakes)|listicle|ranked|comparison|vs-)
lead-form ~ /(apply|book|schedule|demo|contact|get-?(a-)?quote|signup|sign-up|register|waitlist)
app-store ~ (apps\.apple\.com|play\.google\.com|itunes\.apple\.com)
product-page ~ /(products?|item|sku|p)/[^/]+
collection ~ /(collections?|shop|category|categories|all-products|bestsellers)
landing-page ~ /(lp|landing|offer|promo|deal|special|get-?started|try|start)
"""

PAGE_KINDS = r"""
product ~ /(products?|item|sku)/[^/]+$
collection ~ /(collections?|category|categories|shop|catalog)(/|$)
article ~ /(blogs?|articles?|news|stories|journal|learn|guides?)/
quiz ~ /(quiz|assessment|find-your|match|consultation)
policy ~ /(policies|policy|terms|privacy|refund|shipping-policy|legal|returns)
cart ~ /cart(/|$|\.js)
checkout ~ /(checkouts?|thank[_-]?you|order-confirmation)(/|$)
account ~ /(account|login|register|orders)(/|$)
landing ~ /(pages|lp|landing|offer|promo|deal|special|get-started|try)(/|$)
"""

# Tools: name ~ category ~ pattern.
TOOLS = r"""
Meta Pixel ~ adPixel ~ connect\.facebook\.net/[^"']*fbevents|fbq\s*\(\s*['"]init
TikTok Pixel ~ adPixel ~ analytics\.tiktok\.com|ttq\.load\s*\(
Google Ads ~ adPixel ~ googleads\.g\.doubleclick\.net|gtag/js\?id=AW-
Pinterest Tag ~ adPixel ~ s\.pinimg\.com/ct/core\.js|pintrk\s*\(
Snap Pixel ~ adPixel ~ sc-static\.net/scevent|snaptr\s*\(
Reddit Pixel ~ adPixel ~ redditstatic\.com/ads|rdt\s*\(
LinkedIn Insight ~ adPixel ~ snap\.licdn\.com/li\.lms-analytics
Taboola ~ adPixel ~ cdn\.taboola\.com
Outbrain ~ adPixel ~ outbrain\.com/outbrain\.js|obApi\s*\(
Google Analytics 4 ~ analytics ~ gtag/js\?id=G-|googletagmanager\.com/gtag
Google Tag Manager ~ analytics ~ googletagmanager\.com/gtm\.js
Triple Whale ~ analytics ~ triplewhale|triplepixel
Northbeam ~ analytics ~ northbeam\.io
Elevar ~ analytics ~ getelevar\.com
Hotjar ~ analytics ~ static\.hotjar\.com
Microsoft Clarity ~ analytics ~ clarity\.ms
Segment ~ analytics ~ cdn\.segment\.(com|io)
Klaviyo ~ email ~ klaviyo\.com|static\.klaviyo
Mailchimp ~ email ~ chimpstatic\.com|list-manage\.com
Omnisend ~ email ~ omnisend
Drip ~ email ~ getdrip\.com
Sendlane ~ email ~ sendlane
Attentive ~ sms ~ attentivemobile\.com|attn\.tv
Postscript ~ sms ~ postscript\.io
Emotive ~ sms ~ emotive\.io
Recharge ~ subscription ~ rechargepayments\.com|rechargeapps\.com
Skio ~ subscription ~ skio\.com
Loop Subscriptions ~ subscription ~ loopwork\.co|loopsubscriptions
Stay AI ~ subscription ~ stay-ai\.com|retextion
Okendo ~ reviews ~ okendo\.io
Yotpo ~ reviews ~ yotpo\.com
Judge.me ~ reviews ~ judge\.me
Loox ~ reviews ~ loox\.io
Stamped ~ reviews ~ stamped\.io
Trustpilot widget ~ reviews ~ widget\.trustpilot\.com
Fera ~ reviews ~ fera\.ai
Rebuy ~ cro ~ rebuyengine\.com
Nosto ~ personalisation ~ nosto\.com
Dynamic Yield ~ personalisation ~ dynamicyield\.com
Justuno ~ cro ~ justuno\.com
OptinMonster ~ cro ~ optinmonster|omappapi
Privy ~ cro ~ privy\.com|privymktg
Octane AI ~ cro ~ octaneai\.com
VWO ~ cro ~ visualwebsiteoptimizer|vwo\.com
Optimizely ~ cro ~ optimizely\.com
Gorgias ~ support ~ gorgias\.(chat|com)
Intercom ~ support ~ intercomcdn\.com|widget\.intercom\.io
Zendesk ~ support ~ zdassets\.com|zendesk\.com
Tidio ~ support ~ tidio(chat)?\.
Shop Pay ~ payments ~ shop_pay|shopifycloud/shop-js
Klarna ~ payments ~ klarna\.com|klarnaservices
Afterpay ~ payments ~ afterpay\.com
Affirm ~ payments ~ affirm\.com
Sezzle ~ payments ~ sezzle\.com
Refersion ~ affiliate ~ refersion\.com
Impact ~ affiliate ~ impactradius|impact\.com
ShareASale ~ affiliate ~ shareasale\.com
UpPromote ~ affiliate ~ uppromote
"""

STOPWORDS = """
a an the and or but if of to in on at for with by from as is are was were be been being am it its this that these those there here i you
your yours we our ours us they them their he she his her hers him my me mine do does did done have has had having can could will would shall
should may might must so than then what which who whom when where why how all any some each both few such own same into onto about against
between through during above below up down out off again further once because while until also via per etc
""".split()

MULTI_PART_SUFFIXES = """
co.uk org.uk me.uk ac.uk gov.uk net.uk ltd.uk plc.uk com.au net.au org.au id.au edu.au gov.au co.nz net.nz org.nz co.za org.za web.za com.br
net.br org.br com.mx com.ar com.co com.pe co.jp ne.jp or.jp ac.jp co.kr or.kr com.cn net.cn org.cn com.hk com.sg com.my com.tw co.in net.in
org.in firm.in gen.in com.tr com.ua co.il com.sa com.eg com.ng co.ke com.es com.pl com.pt com.gr com.ro com.vn co.id co.th
""".split()

DENY_HOSTS = """
facebook.com fb.com instagram.com twitter.com x.com tiktok.com youtube.com youtu.be pinterest.com linkedin.com reddit.com snapchat.com
threads.net threads.com whatsapp.com telegram.me t.me tumblr.com vimeo.com twitch.tv discord.com discord.gg quora.com amazon.com
amazon.co.uk amazon.de amazon.ca amazon.com.au ebay.com walmart.com target.com costco.com etsy.com sephora.com ulta.com cvs.com
walgreens.com iherb.com gnc.com vitaminshoppe.com bodybuilding.com chemistwarehouse.com.au boots.com superdrug.com holandandbarrett.com
hollandandbarrett.com shopify.com myshopify.com bigcommerce.com squarespace.com wix.com wikipedia.org wikimedia.org nytimes.com forbes.com
businessinsider.com healthline.com webmd.com menshealth.com womenshealthmag.com gq.com vogue.com allure.com cosmopolitan.com buzzfeed.com
medium.com nih.gov ncbi.nlm.nih.gov pubmed.ncbi.nlm.nih.gov fda.gov mayoclinic.org consumerreports.org trustpilot.com sitejabber.com
yelp.com bbb.org google.com googleapis.com gstatic.com doubleclick.net googletagmanager.com cloudflare.com cloudfront.net akamaihd.net
jsdelivr.net unpkg.com gravatar.com w3.org schema.org apple.com microsoft.com adobe.com paypal.com stripe.com klarna.com afterpay.com
affirm.com mailchimp.com hubspot.com zendesk.com intercom.com github.com archive.org bit.ly tinyurl.com linktr.ee
""".split()

EU_COUNTRIES = """
AT BE BG HR CY CZ DK EE FI FR DE GR HU IE IT LV LT LU MT NL PL PT RO SK SI ES SE IS LI NO
""".split()

# Audiences: name ~ term:weight, ...
AUDIENCES = r"""
men ~ for men:4, men's:3.5, guys:2.5, male:2.5, dad:2, him:1
women ~ for women:4, women's:3.5, ladies:2.5, female:2.5, mom:2, her:1
unisex / all genders ~ for everyone:3, unisex:4, gender neutral:4, all genders:4
athletes ~ athlete:4, lifter:3.5, runner:3, crossfit:4, gym-goer:4, bodybuilder:4
seniors / 50+ ~ over 50:4, seniors:4, aging adults:3.5, 65+:4, retirees:4
teens & young adults ~ teen:4, gen z:4, college student:4, young adults:3.5
parents ~ parents:3.5, new mom:4, new parents:4, toddler:3, baby:2
pet owners ~ pet parent:4, dog owner:4, cat owner:4, fur baby:4
professionals ~ busy professional:4, executive:3, founder:2.5, entrepreneur:3
businesses ~ b2b:4, for teams:3.5, enterprise:3, your business:1
hiring managers ~ hiring manager:4, talent acquisition:3.5, your next hire:1
job seekers ~ your next role:4, job seekers:4, apply now:2.5, open roles:1
vegans ~ vegan:3, plant-based:3, dairy-free:2.5
"""

GENERIC_ANCHORS = r"^(here|click here|link|website|site|visit|visit site|shop|shop now|buy|buy now|learn more|read more|see more|view|more|official site|official website|check price|see price|image|photo|source|\d+)$"

LEGAL_FORMS = r"""LLC|L\.L\.C\.|Inc\.?|Incorporated|Corp\.?|Corporation|Co\.|Company|Ltd\.?|Limited|LLP|L\.P\.|LP|PLC|GmbH|mbH|AG|UG|B\.V\.|N\.V\.|S\.A\.|S\.A\.S\.|SAS|SARL|S\.à r\.l\.|S\.r\.l\.|S\.p\.A\.|S\.L\.|Pty\.? Ltd\.?|Pte\.? Ltd\.?|AB|ApS|A\/S|AS|Oy|Oyj|d\.o\.o\.|Sp\. z o\.o\.|s\.r\.o\.|Kft\.?|SRL"""

#: Points a site gets for having any tool of a category.
TOOL_POINTS = {"adPixel": 22, "analytics": 12, "email": 16, "sms": 10, "subscription": 12, "reviews": 12, "cro": 8, "personalisation": 4, "affiliate": 4}
#: Points that detected angles add to an awareness stage.
AWARENESS_BUMPS = (
    (("offer-value", "urgency-scarcity"), "most-aware", 2.0),
    (("mechanism", "ingredient-hero"), "solution-aware", 2.0),
    (("problem-agitation",), "problem-aware", 2.0),
    (("curiosity", "founder-story"), "unaware", 1.5),
    (("us-vs-them", "risk-reversal"), "product-aware", 1.5),
)
# Tools that shape a purchase: name ~ pattern.
CONVERSION_APPS = r"""
Rebuy ~ rebuyengine\.com
Zipify OCU ~ zipify|oneclickupsell
ReConvert ~ reconvert
AfterSell ~ aftersell
Bold Upsell ~ boldapps|bold-upsell
Recharge ~ rechargepayments|rechargeapps
Skio ~ skio\.com
Okendo ~ okendo\.io
Yotpo ~ yotpo\.com
Judge.me ~ judge\.me
Loox ~ loox\.io
Stamped ~ stamped\.io
Gorgias ~ gorgias\.(chat|com)
Klaviyo ~ klaviyo
Postscript ~ postscript\.io
Shop Pay ~ shop_pay|shopifycloud\/shop-js
Klarna ~ klarna
Afterpay ~ afterpay
Affirm ~ affirm\.com
Sezzle ~ sezzle
PayPal ~ paypal\.com|paypalobjects
Amazon Pay ~ amazonpay|payments-amazon
Google Pay ~ pay\.google\.com|googlepay
Apple Pay ~ apple-pay|applepay
"""
# Trust marks: name ~ pattern.
TRUST = r"""
money-back guarantee ~ money.?back guarantee
free shipping ~ free shipping
free returns ~ free returns
cancel anytime ~ cancel any ?time
secure checkout ~ secure checkout|ssl secured
third-party tested ~ third.?party tested
made in USA ~ made in (the )?usa
vegan ~ \bvegan\b
cruelty-free ~ cruelty.?free
subscribe and save ~ subscribe (and|&) save
"""
BNPL = ("Klarna", "Afterpay", "Affirm", "Sezzle")
PRESS = (
    "Forbes", "Vogue", "GQ", "Cosmopolitan", "Allure", "Men's Health", "Women's Health",
    "The New York Times", "New York Times", "Wall Street Journal", "Bloomberg", "TechCrunch",
    "Buzzfeed", "Refinery29", "Harper's Bazaar", "Elle", "Esquire", "Wired", "Goop",
    "Shape", "Well+Good", "Healthline", "Runner's World", "Business Insider", "Fast Company",
)
CERTIFICATIONS = (
    "NSF Certified", "Informed Sport", "Informed Choice", "GMP", "cGMP", "USDA Organic",
    "Non-GMO Project", "B Corp", "Leaping Bunny", "Certified Vegan", "Climate Neutral",
    "Clean Label Project", "Soil Association", "Third-Party Tested", "FSC", "EWG Verified",
)
#: What a shop's words say of its terms.
SUBSCRIPTION = r"\b(subscribe (and|&) save|subscription|auto.?(ship|deliver)|deliver every|cancel any ?time)\b"
FREE_SHIPPING = r"\bfree shipping\b(?!\s*(on|over|above|for orders))"
SHIPPING_OVER = r"free shipping (?:for orders over|on orders over|on orders above|over|above|on)\s*[$£€]?\s*([\d,]+)"
GUARANTEE = r"([\d]{1,3})[\s-]?(?:day|night)s?\s*(?:money.?back|guarantee|trial|promise|risk.?free)"
DISCOUNT = r"(\d{1,2})\s?%\s?off"
REVIEWS = r"([\d][\d,.]*\s?[km]?)\+?\s*(?:verified\s*)?(?:reviews|ratings|customers|happy customers)"
RATING = r"\b([45](?:\.\d)?)\s*(?:\/|out of)\s*5\b"
FOUNDED = r"\b(?:since|est(?:ablished)?\.?|founded in)\s*(19\d{2}|20[0-2]\d)\b"
#: What a product's page and a shop's policies say.
PRODUCT_SUBSCRIPTION = r"\b(subscribe (and|&) save|subscription|deliver every|auto.?ship)\b"
SUBSCRIPTION_DISCOUNT = r"subscribe (?:and|&) save\s*(\d{1,2})\s?%|save\s*(\d{1,2})\s?%\s*(?:on|with) subscription"
PRODUCT_REVIEWS = r"([\d][\d,]*)\s*(?:verified\s*)?(?:reviews|ratings)"
PRODUCT_GUARANTEE = r"(\d{1,3})[\s-]?(?:day|night)s?\s*(?:money.?back|guarantee|trial|risk.?free)"
BUNDLES = r"\b(?:buy|get)\s*\d+\s*(?:,|and|&)?\s*(?:get|save)\s*\d+\s*%?|\d+[\s-]?(?:pack|month supply|bottle bundle)"
DRAWER = r"cart-drawer|drawer__cart|mini-cart|cart-flyout|slide-cart"
CART_LINK = r"href=[\"'][^\"']*\/cart[\"']"
CHECKOUT_OVER = r"free shipping (?:for orders over|on orders over|on orders above|over|above)\s*[$£€]?\s*([\d,]+)"
RETURN_WINDOWS = (r"(\d{1,3})\s*(?:calendar\s*|business\s*)?days?\s*(?:of|from|after|to)\b[^.]{0,40}(?:return|refund|exchange)", r"return[^.]{0,40}?within\s*(\d{1,3})\s*days")
SHIPPING_NOTE = r"free shipping|shipping (cost|rate|fee)|flat rate"
POLICY_PATHS = ("/policies/refund-policy", "/policies/shipping-policy", "/pages/returns", "/pages/shipping")
#: Copy formats, the first that holds: name, flags, least and most words, pattern.
FORMATS = (
    ("listicle", "m", 0, None, r"(^|\n)\s*(\d[.)]|[-•*])\s+\S"),
    ("listicle", "i", 0, None, r"\b\d+ (reasons|ways|things|signs|mistakes|tips)\b"),
    ("advertorial", "i", 250, None, r"\b(i (tried|tested|switched)|my (experience|story)|read on|keep reading)\b"),
    ("testimonial", "", 0, None, "[\"“][^\"”]{40,}[\"”]"),
    ("testimonial", "", 0, None, r"\b—\s?[A-Z][a-z]+( [A-Z]\.)?\b"),
    ("ugc-first-person", "i", 0, None, r"\b(i'?ve been|i started|my (skin|hair|sleep|energy|life)|honestly|ngl|obsessed)\b"),
    ("educational", "i", 0, None, r"\b(here'?s how|how it works|the science|what to look for|step \d)\b"),
    ("direct-offer", "i", 0, 60, r"\b(\d{1,2}% off|shop now|order now|free shipping|use code)\b"),
    ("story", "i", 120, None, r"\b(i |my |we )\b"),
)
PROOF = r"\b\d[\d,.]*\s?(?:%|mg|g|ml|billion|million|k|x)(?![a-z0-9])|\b\d[\d,.]*\s?(?:days?|weeks?|months?|years?|customers|reviews|studies|ingredients|hours?)\b|\b\d(?:\.\d)?\s?(?:\/|out of)\s?5\b"
CLAIM = r"\b(reduces?|boosts?|improves?|increases?|eliminates?|clears?|restores?|supports?|helps?|proven to|designed to|guaranteed to)\b"
CTA = r"\b(shop now|buy now|order now|learn more|sign up|get started|try (it )?(free|now|today)|claim (your|yours)|download|book (a|your)|subscribe|get yours|start (your|now))\b"
TRACKING = r"^(utm_|fbclid|gclid|msclkid|ref|referrer|source|mc_cid|mc_eid|igshid)"
LANDING_TRACKING = r"^(utm_|fbclid|gclid|msclkid|ttclid|twclid|igshid|mc_cid|mc_eid|_ga|ref|referrer|campaign_id|ad_id|adset|placement)"
DENY_PATHS = r"/(privacy|terms|cookie|legal|accessibility|sitemap|dmca|disclaimer)|/(login|signin|signup|register|account|cart|checkout|wishlist)|/(author|tag|tags|category|categories|archive|feed|rss|amp)/|\.(pdf|jpe?g|png|gif|svg|webp|mp4|zip|css|js|xml|ico)$"
PRODUCT_URL = r"/(products?|item|shop|collections/[^/]+/products)/[^/?#]+"


def table(text: str) -> list[list[str]]:
    """The rows of a rule table."""
    return [line.split(" ~ ") for line in text.strip().splitlines()]

# Where a page's content lies, in the order it is looked for.
CONTENT_SELECTORS = ("article", "main", '[role="main"]', ".post-content", ".entry-content", ".article-body", ".post-body", "#content", ".content", ".blog-post")
# Shop systems, first that fits.
PLATFORMS = r"""
shopify ~ cdn\.shopify\.com|Shopify\.(theme|shop|routes)\b|window\.Shopify\b|shopify-section|myshopify\.com
woocommerce ~ woocommerce|wp-content/plugins/woocommerce
bigcommerce ~ bigcommerce\.com|cdn\d*\.bigcommerce
magento ~ Magento|mage/cookies|static/version\d+
squarespace ~ squarespace\.com|static1\.squarespace
wix ~ wix\.com|wixstatic\.com|parastorage\.com
"""
# Profile links.
SOCIALS = r"""
instagram ~ instagram\.com/[A-Za-z0-9_.]+
facebook ~ facebook\.com/[A-Za-z0-9_.\-]+
tiktok ~ tiktok\.com/@[A-Za-z0-9_.]+
youtube ~ youtube\.com/(@[A-Za-z0-9_.\-]+|c/[A-Za-z0-9_.\-]+|channel/[A-Za-z0-9_\-]+)
twitter ~ (?:twitter|x)\.com/[A-Za-z0-9_]+
pinterest ~ pinterest\.[a-z.]+/[A-Za-z0-9_\-]+
linkedin ~ linkedin\.com/company/[A-Za-z0-9_\-]+
"""
# A site's own pages worth reading.
INTERNAL_PAGES = r"/(about|about-us|our-story|story|science|how-it-works|why|mission|shop|collections|products|all-products|bestsellers|faq|ingredients|benefits)(/|$|\?)"
# Landing pages.
CALL_TO_ACT = r"\b(shop|buy|order|get|start|try|claim|add to (cart|bag)|book|apply|subscribe|join)\b"
CART_WORDS = r"\b(add to (cart|bag)|buy now|select size|in stock|sold out)\b"
QUIZ_WORDS = r"\b(question \d|step \d of|take the quiz|find your)\b"
# Who stands behind a site: what a trademark line, a contract and a copyright line say, and what each kind of page is worth.
TRADEMARK = r"([A-Z][\w'’\-]{2,40})\s*[®™]?\s*(?:is|are)?\s*(?:a\s+)?(?:registered\s+)?trademarks?\s+(?:of|owned by)\s+"
CONTRACTS = (r"(?:between|with)\s+you\s+and\s+", r"(?:operated|owned|provided|run)\s+by\s+", r"(?:these\s+terms[^.]{0,40}?\s+with\s+)", r"(?:a\s+(?:service|brand|product)\s+of\s+)", r"(?:is\s+a\s+(?:trading|registered)\s+name\s+of\s+)")
COPYRIGHT = r"(?:©|\(c\)|copyright)\s*(?:\d{4}(?:\s*[-–]\s*\d{4})?)?\s*"
PAGE_SOURCES = {"terms": ("terms-of-service", 45), "privacy": ("privacy-policy", 40), "contact": ("contact-page", 25), "about": ("contact-page", 20), "home": ("footer-copyright", 30), "other": ("footer-copyright", 20)}
IDENTITY_PATHS = (
    ("/policies/terms-of-service", "terms"), ("/pages/terms-of-service", "terms"), ("/terms", "terms"), ("/terms-of-service", "terms"), ("/policies/privacy-policy", "privacy"), ("/privacy", "privacy"),
    ("/privacy-policy", "privacy"), ("/pages/contact", "contact"), ("/contact", "contact"), ("/pages/about", "about"), ("/about", "about"),
)

# Niches and their sub-niches, with the audiences a sub-niche hints at behind a bar. The several hundred weighted terms are not listed
# here: `classify.built_in` derives terms from these names by a rule, and a run's `taxonomy` option gives its own.
NICHES = r"""
Supplements ~ Men's health | men; Women's health | women; Sports & performance | athletes; Gut & digestive; Sleep & stress; Nootropics & focus; Weight management; Greens & wholefood; Vitamins & minerals; Longevity & healthspan; Immunity
Skincare ~ Anti-aging; Acne & blemish; Hydration & barrier; Brightening & pigmentation; Sun care; Body care; Men's skincare | men; Clean & natural
Haircare ~ Hair growth & loss; Scalp health; Styling & treatment; Color
Beauty & cosmetics ~ Makeup; Fragrance; Nails & lashes; Tools & devices
Sexual wellness ~ Male sexual health | men; Female sexual health | women; Contraception & fertility
Health & telehealth ~ Telehealth & Rx; Diagnostics & testing; Wearables & tracking
Food & beverage ~ Functional drinks; Coffee & tea; Snacks & bars; Meal & nutrition
Fitness & apparel ~ Activewear; Equipment; Programs & coaching; Recovery
Apparel & accessories ~ Everyday apparel; Footwear; Jewellery & watches; Eyewear; Underwear & intimates
Home & lifestyle ~ Sleep & bedding; Cleaning & household; Kitchen & cookware; Air & water
Baby & family ~ Baby care | parents; Kids | parents
Pet care ~ Pet supplements | pet owners; Pet food | pet owners; Pet accessories | pet owners
Mental health & mindfulness ~ Therapy & counselling; Meditation & habit
CBD & alternatives ~ CBD & hemp; Functional mushrooms; Nicotine & cessation
Tech & gadgets ~ Consumer electronics; Smart home; Software & SaaS | businesses
Finance & services ~ Fintech; Insurance
Professional & B2B services ~ Recruitment & staffing | businesses, hiring managers; Marketing & creative agency | businesses; Consulting & advisory | businesses; Software & IT services | businesses; Training & education; Legal, finance & compliance services | businesses
Outdoor & travel ~ Outdoor gear; Travel
"""
