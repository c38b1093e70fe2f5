"""The labelled URLs that the URL filter is trained on: sites written out row by row, host and path.

Names of kinds of sites, some of them well-known ones; none is made by a rule. Rows of WANTED hold
parts of unwanted words (sussex, assets, therapist, cocktail, betterment), as such names exist.
"""

UNWANTED = """
royalspincasino.org /bonus
casino-nova.net /en/slots
m.megacasino24.info /
onlinecasinoreviews.biz /top10
vegasslotsfree.com /play
slotmachines77.net /
luckyslots.club /spin
pokerstrike.net /tables
holdem-poker-room.net /lobby
roulettewheel.info /
www.bingobonanza.co.uk /join
jackpot-win-city.org /register
sportsbetting-odds.com /tips
betwinner24.net /live
freebets-daily.co.uk /offers
bet-on-football.net /
mybetting.tips /today
gambling-guide.info /
lottery-jackpot-claims.org /claim
hotsexcams.com /live
sexchat-now.net /rooms
xxxvideos-hd.net /watch/123
freexxx.tube /
pornmovies4u.org /cat/2
bestporn.site /
adultfriends-dating.com /join
adultvideos.club /
www.adult-webcams.net /rooms
nudemodels.pics /gallery
eroticstories.xxx /
escorts-city.biz /book
localhookups.net /meet
singles-tonight.net /chat
fetishworld.org /
sexyangels.net /
viagra-online-cheap.org /buy
cialis-generic.net /order
cheappills.biz /cart
pillshop24.com /checkout
canadian-pharmacy-rx.net /buy
buymeds-noprescription.net /
rxdiscountmeds.org /order
steroids-for-sale.net /
weightloss-miracle.info /try
dietpills-now.com /
miracle-cures.shop /
paydayloans-fast.net /apply
instant-cash-loans.net /apply
badcredit-loans.info /
debt-relief-now.biz /
forex-signals-profit.org /join
cryptodoubler.io /invest
bitcoin-profit-trader.com /signup
getrichquick.biz /
earn-money-fast.info /start
make-cash-online.net /
binaryoptions-win.net /
adserver.clickmedia.net /ads/show
ads.popunder.org /serve
adtrack.biz /pixel.gif
track.click-offers.net /aff/12
clicktracker.info /click
popads-network.com /
bannerads-exchange.net /banner
pixel.adstats.io /t.gif
affiliate-tracking.net /aff
buytraffic.biz /redirect
buy-backlinks-cheap.org /order
seo-linkfarm.net /links
spamlinks.info /
freespam-mailer.com /
buy-likes-fast.net /
cheapfollowers.net /buy
freephone-giveaway.org /win
claimyourprize.win /claim
you-are-a-winner.info /prize
giftcards-free.net /survey
free-coins-generator.com /
survey-rewards.club /
warezworld.net /download
crackedsoftware.org /keygen
serialkeys-crack.net /
torrentmovies-free.net /torrent
piratestream.to /watch
free-movies-hd-stream.net /
cheats-hacks-download.org /
replica-watches-shop.com /sale
cheap-handbags-outlet.biz /
counterfeit-notes.net /
fakepassports-online.net /
essaywriters-cheap.org /order
buy-essays-online.net /
antivirus-alert-warning.com /scan
your-pc-infected.info /
login-verify-account.net /secure
account-update-secure.net /login
malware-download.net /setup.exe
"""

WANTED = """
en.wikipedia.org /
www.gutenberg.org /ebooks/1342
archive.org /
www.nature.com /articles/s41586
arxiv.org /
www.who.int /news/item
ec.europa.eu /
www.gov.uk /guidance/waste
www.nasa.gov /
data.census.gov /table
www.loc.gov /
bundestag.de /dokumente
www.legifrance.gouv.fr /
www.elpais.com /ciencia/2021
www.lemonde.fr /
www.theguardian.com /environment/2020
www.bbc.co.uk /
www.nytimes.com /2019/05/02/world
www.repubblica.it /
www.zeit.de /wissen/2022
www.asahi.com /
timesofindia.com /city
github.com /
docs.python.com /3/library
stackoverflow.com /
developer.mozilla.net /en-US/docs
www.postgresql.org /
kernel.org /doc/html
www.rust-lang.org /
pubmed.ncbi.nlm.nih.gov /3141592
www.mayoclinic.com /
www.nhs.uk /conditions
hospital-stmary.info /
childrensclinic.net /team
www.sussex.ac.uk /
essexcountycouncil.gov.uk /planning
middlesex-history.com /
www.ox.ac.uk /research
web.mit.edu /
www.ethz.ch /de/forschung
uni-heidelberg.de /
univ-lyon.fr /recherche
unam.mx /
ubc.ca /forestry
www.cityofboulder.gov /
villagehall-ashby.org.uk /events
greenvalleyschool.edu /
northside-library.net /opening-hours
www.metmuseum.org /
naturalhistorymuseum.net /exhibits
www.philharmonic.com /
operahouse-tickets.info /season
poetryfoundation.org /
www.openstreetmap.org /node/42
weather.gov /
www.metoffice.gov.uk /climate
riverconservation.com /
mountain-rescue.net /about
alpinehiking.ch /
sailingclub-kiel.de /termine
www.birdlife.org /
gardenersworld.com /plants
grandmas-kitchen.net /
breadandbutterbakery.com /menu
cocktail-recipes.net /
coffeeroasters.co /beans
www.lonelyplanet.com /
railjourneys.eu /timetable
airport-zurich.ch /
harbourmaster.no /tides
localnewsgazette.com /
theherald.com.au /national
smalltowntribune.com /
blog.historyofmaps.net /1600s
knittingpatterns.net /
woodworkersguild.com /joinery
handmade-pottery.com /
physiotherapist-directory.info /knee
massage-therapist-school.edu /
assetsurvey.gov /roads
classicalguitar.net /
alphabet-for-kids.com /letters
betterment-of-soils.net /
elizabeth-bennet.com /letters
windows-help.net /
adelaide.edu.au /admissions
address-standards.info /
adoption-advice.org.uk /families
specialist-nurses.com /
clickandcollect-library.gov.uk /books
scunthorpe.gov.uk /
pillowlavas.net /geology
caterpillars-and-moths.net /
torrential-rain-studies.edu /flood
loanwords-in-english.com /
freedomhouse.info /report
winterolympics-history.com /
"""


def rows() -> list[tuple[str, str, int]]:
    """(host, path, 1 if unwanted) of every row."""
    return [(*line.split(), label) for text, label in ((UNWANTED, 1), (WANTED, 0)) for line in text.strip().split("\n")]
