"""Hand-labelled URLs, invented ones, for the URL filter: whole URLs a person would keep or block, one host each.

More are kept than blocked, as on the web: a host that looks like neither is kept.
"""

from __future__ import annotations

#: URLs that are to be kept.
KEEP = """
http://www.citylibrary.org/catalogue/new-books
https://riverside-museum.org/exhibitions/2021/bronze-age
http://blog.slowgarden.net/2019/04/tomatoes-in-pots.html
https://news.northcoast-daily.com/local/council-votes-on-bridge
https://docs.pyfields.io/en/stable/install.html
http://wiki.oldmaps.info/index.php/Mercator_projection
https://www.hillside-school.edu/students/timetable
http://recipes.grandmas-kitchen.com/bread/sourdough
https://www.stmarys-hospital.org/visitors/parking
http://m.weatherstation.net/forecast/tomorrow
https://journal.marinebiology.org/articles/10/2/plankton
http://forum.woodworkers.co.uk/topic/3312-dovetail-joints
https://www.gov.example-county.us/permits/building
http://astronomy.dept-physics.edu/courses/ph201/notes.pdf
https://blog.mountainrunner.de/2020/07/alpen
http://www.bikeshop-amsterdam.nl/service/repair
https://translations.poetryhouse.fr/verlaine/chanson-d-automne
http://cooking.lacasa.es/recetas/tortilla-de-patatas
https://www.trainhistory.jp/steam/timeline
http://en.encyclofacts.org/wiki/Photosynthesis
https://radio.jazznight.fm/schedule
http://www.smallfarmers.net/livestock/goats
https://openmaths.org/algebra/linear-equations
http://genealogy.familyroots.com/surnames/miller
https://www.oceanographic.institute/reports/2018
http://parents.kindergarten-sonnenschein.de/termine
https://status.cloudhosting.io/incidents
http://www.knitters-guild.org/patterns/scarf
https://chess.clubnight.net/games/1972
http://birdwatch.island.nz/species/kiwi
https://theatre.oldtown.org/season/hamlet
http://www.watchmakers.ch/history/escapement
https://photography.lightandlens.com/tutorials/aperture
http://m.busroutes.city/line/42
https://archive.historypapers.org/1848/letters
http://blog.codewithcoffee.dev/posts/unit-testing
https://www.veterinary-clinic.com/advice/puppies
http://www.potteryworkshop.co.uk/classes
https://science.dailyreader.com/space/mars-rover
http://geology.rocksandminerals.net/quartz
https://www.orchestra-philharmonic.org/tickets
http://mobile.stadtwerke.de/strom/tarife
https://help.mailservice.com/articles/reset-password
http://www.vegetarianrecipes.net/soups/lentil
https://law.universitypress.org/books/contracts
http://sailing.harbourclub.org/tides
https://www.townhall.ie/minutes/2017-11
http://linux.beginnersguide.org/commands/grep
https://economics.policybrief.org/papers/inflation
http://www.beekeeping.farm/hives/winter
https://english.grammarhelp.com/verbs/irregular
http://www.pianolessons.music/scales
https://www.camping-provence.fr/tarifs
http://travel.lonelyroads.com/iceland/ring-road
https://www.nationalpark.gov/trails/canyon
http://history.villagechurch.org.uk/parish-register
https://data.statisticsoffice.gov/population
http://www.crosswords.press/today
https://www.architecture-review.com/2015/concrete
http://m.lokalzeitung.de/sport/handball
https://maps.hikingtrails.org/route/118
http://www.toolreviews.net/drills/cordless
https://nursing.healthcollege.edu/admissions
http://www.bookclub.reviews/novels/middlemarch
https://blog.statisticsnotes.com/bayes-theorem
http://www.localfoodbank.org/donate
https://engineering.bridgeworks.com/steel
http://dictionary.wordroots.org/etymology/window
https://www.modelrailways.net/layouts
http://yoga.morningpractice.com/breathing
https://www.filmarchive.org/silent/1925
http://medicine.journalclub.net/cardiology/2014
https://www.childrensbooks.co/picture-books
http://www.electricalcode.info/wiring
https://www.swimmingclub.org.au/results
http://physics.openlectures.org/thermodynamics/entropy
https://www.cathedraltours.it/orari
http://blog.homebrewing.beer/hops
https://www.fireservice.gov.uk/safety/alarms
http://www.runnersworld.run/plans/10k
https://biblioteca.ayuntamiento.es/horario
http://www.ecology.center/wetlands
https://www.scoutgroup.org/badges
http://old.computermuseum.net/exhibits/punch-cards
https://www.apprenticeships.gov/electrician
http://www.winterolympics.news/biathlon
https://support.printerdrivers.com/manuals
http://www.pharmacology-lectures.edu/enzymes
https://www.sussexcoast.co.uk/walks
http://lyrics.folksongs.org/ballads
https://www.essex-heritage.org/churches
http://www.cocktailgarden.com/menu
https://www.scunthorpe-times.co.uk/letters
http://medical.analysisgroup.org/assays
https://www.betterhomes.org/insulation
http://www.alphabetsoup.com/toddlers
https://www.slotcars-hobby.com/tracks
http://www.pokerhouse-pottery.com/opening-hours
https://www.campusradio.edu/archive
http://www.videography.school/lighting
https://www.downloadable-worksheets.com/maths/fractions
http://www.freelance-translators.org/rates
https://www.cheapskate-gardener.com/compost
http://www.dealerships-guide.com/used-cars
https://www.loanwords.linguistics.edu/french-in-english
http://www.cracked-pots.org/ceramics/glaze
https://www.trackandfield.org/results/2012
http://www.clickbeetles.info/species
https://www.adulteducation.gov/evening-classes
http://www.winchester.gov.uk/planning
https://www.bonusmaterial-dvd.com/reviews
http://www.pillowmakers.com/feather
https://www.gameofgo.org/openings
http://www.luckycat-teahouse.com/teas
https://shop.seedcatalogue.com/carrots
http://www.europarl-debates.eu/en/2009
https://agenda.mairie-lyon.fr/concerts
http://www.wanderverein.de/touren/schwarzwald
https://ayuda.correo.es/preguntas
http://www.hotel-bellavista.it/camere
https://cdn.opensourcefonts.org/serif
http://api.railtimes.org/v1/stations
https://www.townplanning.org/cycle-lanes
http://www.quantumnotes.net/spin
https://www.cellbiology.edu/mitosis
http://www.antiquarian-books.co/catalogue
https://www.localelections.org/candidates
http://www.wheatprices.net/weekly
https://www.soilscience.org/clay
http://www.teachersroom.net/lesson-plans
https://www.choirpractice.org/scores
http://blog.unitconverter.org/miles
https://www.lighthousekeepers.org/logs
http://m.familydoctor.org/symptoms/cough
https://www.rustlanguage.dev/book/ownership
http://www.threadsandneedles.com/sewing
https://www.insectatlas.org/beetles
http://www.heatpumps.guide/installation
https://www.universityhospital.edu/cancer/trials
http://www.windmills.nl/kinderdijk
http://m.ruralnews.net/weather
https://www.metalworking-tips.net/welding
http://blog.theatrelovers.net/ibsen
https://thethirdbrother.net/en/chapter-3
http://www.northernthreads.net/wool/2041
https://blog.thatchedroofs.com/en/812.html
http://m.windowcleaners.net/prices?page=2
https://www.stationmaster.net/es/horarios/77
http://grandtheory.example.net/en/55
https://m.otherworldly-tales.net/en/story-9
http://www.heritagetrains.example.com/de/301.html
https://blog.lastharvest.example.org/en/1290
http://thornbury-parish.net/news/612
https://www.therapists-directory.net/towns
http://m.breadandbutter.net/breakfast
https://blog.tinyhouses.net/en/4512?utm_source=feed
http://www.stonewalls.net/dry-stone
https://tidetables.net/harbour/114
http://www.mathematicians.net/euler
https://m.thames-rowing.com/en/races/2011
http://thundercloud-weather.com/radar
https://www.northumbria-walks.net/route-7
http://blog.handwriting.net/italic
https://www.anthropology.net/kinship
http://m.hanseatic-history.com/de/luebeck
https://www.andesguide.net/es/rutas
http://www.renaissance-music.net/lute
https://blog.engineer-notes.net/pumps
http://m.rathaus-news.com/de/2290
https://www.ornithology.net/warblers
http://tonguetwisters.net/en/121
https://www.nationstates-atlas.com/borders
http://blog.lithography.net/prints
https://m.interestingtimes.net/en/8081
http://www.entomology-notes.com/wasps
https://www.herbgarden.net/thyme
http://m.theologians.net/augustine
https://blog.ironbridges.com/telford
http://www.reading-room.net/essays/312
https://www.rheinland-wandern.com/de/touren
http://m.hearthandhome.net/stoves
https://blog.rainforest.net/canopy
http://www.handball-verein.net/spiele
https://www.antarctica-diary.com/day/41
http://thatswhatshesaid-quotes.net/office
https://m.seabirds.net/puffin
http://www.lanternfestival.com/programme
https://blog.shepherds.net/lambing
http://www.redbrick-university.net/history
https://m.oldestpubs.com/york
http://www.erosion-control.net/slopes
https://www.rotary-club.net/meetings
http://blog.nutrition-facts.net/iron
https://www.cameras-history.com/leica
http://m.adventure-walks.net/cliffs
https://www.advancedmaths.net/limits
http://www.addressbook.net/help
https://blog.admirals.net/nelson
http://www.trackbed-cycling.com/maps
https://m.lakes-district.net/coniston
http://www.livestream-lectures.com/chemistry
https://www.hotspring-inn.com/rooms
http://blog.girlguides.net/camp
https://www.boysbrigade.com/band
http://www.teenreads.net/mysteries
https://m.moneymuseum.com/coins/roman
http://www.cashcrops.net/cotton
https://www.claims-handbook.com/insurance
http://blog.verified-facts.net/method
https://www.freedomtrail.com/boston
http://m.freeschoolmeals.net/apply
https://www.freshwater-fish.net/trout
http://www.betatesters.net/reports
https://blog.alphabeta.net/greek
http://m.sexton-family.net/genealogy
https://www.middlesex-cricket.net/fixtures
http://www.xylophone.net/lessons
https://www.pilgrim-paths.com/santiago
http://m.speculative-fiction.net/asimov
https://blog.download-speed.net/fibre
""".split()
#: URLs that are to be blocked.
BLOCK = """
http://www.royal-casino-online.com/bonus/welcome
https://casino-spins.net/slots/free
http://m.bestcasino.bet/jackpot
https://luckycasino777.org/register-bonus
http://play.vegas-casino.bet/roulette
https://www.poker-online-cash.com/tournament/free-chips
http://pokerstars-bonus.net/play/now
https://texas-poker.win/deposit
http://www.slots-mania.com/free-spins
https://megaslots888.net/spin/jackpot
http://bet365-mirror.info/sports-betting
https://www.betting-tips.win/odds
http://m.sportsbet-bonus.com/free-bet
https://bingo-jackpot.net/play
http://www.free-porn-videos.net/watch/hot
https://porntube-xxx.com/video/anal
http://xxx-movies.org/gallery/amateur
https://m.sexcams-live.com/cams/girls
http://www.adult-dating.net/hookup
https://adult-videos-tube.com/watch
http://hot-sex-chat.org/girls/nude
https://nude-teens.xxx/gallery
http://www.milf-porn.tv/xxx/video
https://livesex-webcams.net/free
http://escort-girls.city/sexy/tonight
https://www.erotic-massage.org/escorts
http://blog.adult-stories.net/sex/taboo
https://hentai-xxx.info/porn/gallery
http://fetish-adult.com/videos/xxx
https://www.nudecelebs.net/leaked
http://www.cheap-viagra.com/buy/pills
https://buy-cialis-online.net/order/no-prescription
http://canadian-pharmacy-pills.com/viagra
https://www.diet-pills-fast.net/order-now
http://cheap-pills.info/buy/xanax
https://online-pharmacy-rx.org/cheap/tramadol
http://steroids-shop.net/buy/anabolic
https://penis-enlargement.org/pills/buy-now
http://www.payday-loans-fast.com/apply/instant-cash
https://instant-payday-loan.net/no-credit-check
http://cash-advance-loans.org/apply-now
https://bad-credit-loans.info/instant/approval
http://www.crackz-keygen.net/download/serial
https://warez-download.org/cracked/full-version
http://m.warez-torrents.com/download/crack.exe
https://keygen-serials.info/crack/photoshop
http://www.free-cracks.net/keygen/windows
https://torrent-movies-free.com/download/full
http://pirated-software.org/torrent/crack
https://nulled-scripts.net/download/nulled
http://ads.popup-tracker.com/click/redirect
https://adserver.click-tracking.net/popunder
http://track.affiliate-clicks.com/redirect/offer
https://www.banner-ads.net/popup/promo
http://adclick-redirect.info/track/aff_id
https://push.popunder-ads.com/click
http://www.get-rich-quick.net/make-money-fast
https://make-money-online.win/free-cash
http://bitcoin-doubler.org/invest/double-your-money
https://crypto-giveaway.win/claim/free-bitcoin
http://free-iphone-winner.com/claim/prize
https://www.prize-winner.info/congratulations/claim
http://survey-gift-cards.net/claim/free-gift
https://lottery-winner.org/claim-prize-now
http://secure-paypal-login.info/verify/account
https://appleid-verify.net/login/confirm-account
http://bank-login-verify.com/update/password
https://account-suspended.info/verify/login
http://www.replica-watches-cheap.com/buy/rolex
https://cheap-handbags-outlet.net/replica/gucci
http://fake-designer.org/replica/buy-cheap
https://www.cheap-jerseys-outlet.com/wholesale/buy
http://buy-followers-likes.net/instagram/cheap
https://cheap-seo-backlinks.com/buy/links
http://essay-writers-cheap.org/buy/essay
https://www.fake-diploma.net/buy/degree
http://hack-facebook.info/download/hack-tool
https://free-hacks-cheats.net/download/aimbot
http://phone-spy-hack.com/download/spy
https://www.gold-hack-generator.net/free-coins
http://blog.online-casino-tips.net/bonus/no-deposit
https://www.adult-webcams.org/live/sex
http://m.hot-girls-dating.com/sexy/singles
https://russian-brides-dating.net/singles/hot
http://xxxcams.net/live/girls
https://www.freexxx.org/porn/free
http://www.casino-royale-bonus.org/play
https://blog.casino-games-free.com/blackjack
http://m.online-casino.org/roulette/bonus
https://www.casino-jackpot.info/slots
http://free-casino-bonus.org/no-deposit
https://m.poker-room-bonus.org/play/poker
http://www.free-poker-chips.com/poker
https://www.video-poker-slots.org/casino
http://slots-casino.org/free-slots
https://m.slot-machines-online.com/slots
http://www.best-bets-today.org/betting
https://online-betting-sites.com/bets
http://m.football-bets.org/bet-now
https://www.betting-odds-bonus.com/free-bets
http://blog.sports-betting.org/bets
https://www.free-bingo-bonus.org/bingo
http://m.porn-free.org/porn
https://blog.porn-videos.com/sex/porn
http://www.amateur-porn.org/porn/amateur
https://m.teen-porn.com/porn/teen-sex
http://www.gay-porn-tube.org/xxx
https://xxx-porn.org/xxx/porn
http://m.xxx-tube.com/xxx/videos
https://blog.xxx-pics.org/xxx/nude
http://www.sex-videos.org/sex/free
https://m.sex-dating.com/sex/tonight
http://www.free-sex.org/sex/live
https://sex-toys-cheap.com/buy/sex
http://m.adult-movies.org/adult/xxx
https://www.adult-chat.com/adult/live
http://blog.adult-cams.org/adult/webcams
https://adult-escorts.com/escorts
http://m.escorts-tonight.org/escort/girls
https://www.sexy-escorts.com/escort
http://erotic-stories.org/erotic/sex
https://m.erotic-videos.com/erotic
http://www.nude-girls.org/nude
https://blog.nude-pics.com/nude/sexy
http://www.hot-milf.org/milf/porn
https://m.webcam-girls.com/live/webcams
http://live-webcams-sex.org/webcam
https://www.hentai-porn.com/hentai
http://m.dating-singles.org/hot/singles
https://www.hookup-dating.com/dating/tonight
http://www.buy-viagra.org/viagra/cheap
https://m.viagra-cheap.com/buy/viagra
http://www.cialis-viagra.org/pills
https://blog.cheap-pills-online.com/buy/pills
http://m.weight-loss-pills.org/pills
https://www.pharmacy-cheap.com/buy-online
http://no-prescription-pharmacy.org/pills
https://m.xanax-online.com/buy/xanax
http://www.payday-loans.org/payday/loan
https://m.payday-cash.com/loans/instant
http://www.instant-loans.org/cash/loan
https://quick-cash-loans.com/payday
http://m.crack-download.org/crack/keygen
https://www.software-cracks.com/download/crack
http://keygen-crack.org/keygen
https://m.warez-crack.com/warez
http://www.warez-free.org/warez/download
https://blog.torrent-downloads.com/torrent
http://free-torrents.org/torrent/movies
https://m.movie-torrents.com/download/torrent
http://www.ads-clicks.org/click/ads
https://m.popup-ads.com/ads/popup
http://ads-server.org/ads/track
https://www.ad-tracker.com/track/click
http://m.ads-network.org/banner/ads
https://click-redirect.com/redirect/click
http://www.tracking-ads.org/tracker
https://m.earn-money-online.com/money/fast
http://www.make-money-home.org/money
https://fast-cash-money.com/cash/free
http://m.free-bitcoin.org/bitcoin/claim
https://www.bitcoin-cash-free.com/claim
http://www.win-prizes-free.org/winner/prize
https://m.prize-claim.com/prize/claim
http://free-gift-winner.org/claim/gift
https://www.lottery-prize.com/lottery/winner
http://m.verify-account-login.org/verify
https://www.paypal-verify.com/login/account
http://login-verify-account.org/secure/login
https://m.bank-account-verify.com/verify/login
http://www.replica-watches.org/replica/buy
https://cheap-replica-bags.com/replica
http://m.replica-rolex.org/cheap/watches
https://www.cheap-outlet-bags.com/outlet/cheap
http://buy-cheap-followers.org/followers
https://m.cheap-essays.com/essay/buy
http://www.hack-tools.org/hack/download
https://game-hacks-free.com/hacks/cheats
http://m.hack-password.org/hack
https://www.cheats-hacks.com/cheat/download
""".split()


def rows() -> list[tuple[str, int]]:
    """``(url, label)``; the label is 1 for those to be blocked."""
    return [*((u, 0) for u in KEEP), *((u, 1) for u in BLOCK)]
