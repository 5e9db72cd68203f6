"""Fixed values that must equal the original tool's for identical results.

Everything below is data, kept verbatim and in its natural order:
literal phrases removed by ``clean_text``, the character sets folded by it,
the keyword list used to find relevant sentences, and the regex rule tables
that detect scrape failures. Patterns are in Python ``re`` syntax, matched
case-insensitively from the start of the text; ``quire.functions.patterns``
renders them for the JVM (and for the DuckDB oracle).
Duplicates and known quirks (a missing comma gluing two error patterns,
unescaped ``|`` in site names, ``^b|Browse$``) are deliberate: they are part
of the behaviour being reproduced.
"""

# ---- FIXED VALUES (do not edit: results depend on them) ----

# Hyphen / dash code points folded to "-" (13 entries).
HYPHEN_LIKE = (
    "\u002D\u058A\u2010\u2011\u2012\u2013\u2014"
    "\u2015\u2E3A\u2E3B\uFE58\uFE63\uFF0D"
)

# Quotation-mark-like code points folded to "'" (24 entries).
QUOTE_LIKE = (
    "\u00BB\u00AB\u25B7\u2018\u2019\u201C\u201D\u2039\u203A\u300C\u300D\u300E"
    "\u300F\u301D\u301E\u301F\uFE41\uFE42\uFE43\uFE44\uFF02\uFF07\uFF62\uFF63"
)

# Python's string.punctuation, stripped from both ends by clean_text.
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# Texts treated as "known dubious": the characters of the word X-MOL, each alone.
DUBIOUS_TEXTS = ("X", "-", "M", "O", "L")


# Literal phrases deleted anywhere in the text, applied in this order (95 entries).
BOILERPLATE_PHRASES = [
    'more resources\n\n\nFull Text Sources',
    'more resources\n\n\nFull Text Sources\n\n\nMiscellaneous',
    'Italia Olivicola Consorzio Nazionale',
    'more resources\n\n\nFull Text Sources\n\n\nResearch Materials',
    'Texas A&M AgriLife Research and Extension Center at Amarillo',
    'Journal of Pest Science',
    'Groenten & Fruit Actueel',
    'Egyptian Journal of Biological Pest Control',
    '20℃\n有效期：1 Year\n货期：1 Month\n其他：\n产品介绍：\n订货信息',
    'Texas Crop and Weather Report',
    'Beyond Pesticides Daily News Blog',
    'Pugliapress - Quotidiano online',
    'more resources\n\n\nFull Text Sources\n\n\nResearch Materials\n\n\nMiscellaneous',
    'Quotidiano di Notizie Gratuite',
    'European Journal of Plant Pathology',
    'Global Plant Protection News',
    'Oltre Free Press - Quotidiano di Notizie Gratuite',
    'Journal of Plant Pathology',
    'IVIA - Generalitat Valenciana',
    'International Journal of Tropical Insect Science',
    'The Document has moved here',
    'Magazine di informazione regionale della Puglia',
    'Información económica y empresarial de Huelva',
    'سامانه علمسنجی اعضای هیات علمی',
    'Roma, 18 set. (Adnkronos)',
    'reviewed Open Access journal.',
    'Environmental Science and Pollution Research',
    'Journal of Plant Diseases and Protection',
    'California Fresh Fruit Magazine',
    'Center for Invasive Species Prevention',
    'Video Dailymotion Watch fullscreen',
    'Roma, 24 ott. (Adnkronos)',
    'Italia Olivicola National Consortium',
    'Independent and short film streaming platform.',
    'Vidéo Dailymotion Watch fullscreen Font',
    'Crise de la filière viti',
    'Biblioteca Virtual da FAPESP',
    'Consiglio Regionale della Puglia',
    'DI SPACCIO DEL NORD',
    'Microbes protect a leaf beetle',
    'Fruit &amp; Vegetables News',
    'Free Stock Photos from Dreamstime',
    'Free & Royalty-Free Stock Photos from Dreamstime',
    'Israel Agricultural Technology & innovations Hub',
    'Fruit & Vegetable Magazine',
    'Idea Radio nel Mondo',
    'FI,30,WWF,125,xanthi asteras tripolis livestreaming,1,xanthi panathinaikos livestreaming,1,XHMEIA,1,Xylella fastidiosa,107,Xylotrechus chinensis,1,YARA,3,ZEA,2,ZIZANIOKTONA,3,ZOOTECHNIA,1,\n\n\n\nΣχόλια',
    '\\d\\d\\d\\d GoDaddy, LLC. All rights reserved. Privacy Policy',
    'Instituto de Agricultura Sostenible',
    'Instituto Valenciano de Investigaciones Agrarias (IVIA)',
    'Álvaro Guerrero\nSan Rafael, Ver.',
    '2018 中国地质图书馆版权所有 京ICP备05064691号 京公网安备11010802017129号\n地址：北京市海淀区学院路29号 邮编：100083\n电话：办公室：(+86 10)66554848；文献借阅、咨询服务、科技查新：66554700',
    'Library مفت الکترونیکی کتابتون',
    'الجمعية العربية لوقاية النبات',
    'la voce a Sud',
    'City of Buena Park',
    'Corriere di Puglia e Lucania',
    'time.news - Time News',
    'Centre for Functional Ecology',
    'City of Orange California',
    'National Agricultural Research Center',
    'Rotary Club Le Port',
    'Il periodico dei viticoltori italiani',
    'Millevigne - Il periodico dei viticoltori italiani',
    'Economic and business information on Huelva',
    'Performance of the domestic Bt',
    'BOLETIN OFICIAL REPUBLICA ARGENTINA',
    'In pubblicazione il bando della sottomisura 8.1',
    'Martínez de la Torre, Ver.',
    'O InnovPlantProtect (InPP) e a Direção',
    'Offre publiée il y a 3 jours',
    'CABI Agriculture and Bioscience',
    'Academic Journals - African Journal of Agricultural Research',
    'Studio Aperto Video | Mediaset Infinity',
    'The British Society for Plant Pathology',
    'Composts, Soils, Mulch, Ginseng',
    "Greg Alder's Yard Posts: Southern California food gardening",
    'Discover Open Access Resources',
    'KAMA International Organic pvt ltd.',
    'Ré à la Hune',
    'ScienceDaily - Verve times',
    'University of Florida, Institute of Food and Agricultural Sciences',
    'Eden Prairie Local News',
    'Annals of Forest Science',
    'Sabuj Sathi | Agriculture Solution',
    'La Voce di Maruggio',
    'vous ou créez un compte.',
    'Fonte immagine: Antenna SudSALENTO',
    'Fonte immagine: il Giornale di PugliaBARI',
    'Tous nos articles et événements',
    'Nieuws en kennis voor de akkerbouwers',
    'ALTIARA | Naturalmente productivo',
    'الموقع العلمي للدكتور الحسن اشباني',
    'Business24 La TV del Lavoro',
    "FR\nEN\nMétéo\nNewsletters\nMagazine\nSe connecter\nJe m'abonne pour 1€\nViticulture\nOenologie\nCommerce/Gestion\nPolitique\nGens du vin\nSERVICES\nNewsletters\nMétéo\nVindexer\nVidéos/Podcasts\nEmploi\nIndex des produits œnologiques\nMachines à vendanger\nViniconnect\nIntervignes\nAgenda\nCommunication\nRechercher\nS'abonner\nViticulture\nOenologie\nCommerce/Gestion\nPolitique\nGens du vin\nServices\n<",
]

# Keywords / keyphrases; case-insensitive substring search (32 entries).
KEYWORDS = [
    'fusarium',
    'oxysporum',
    'tropical',
    'xylella',
    'Bursaphelenchus',
    'xylophilus',
    'Bactrocera',
    'dorsalis',
    'huanglongbing',
    'Popillia',
    'japonica',
    'flavescence',
    'first report plant disease',
    'new plant health',
    'ToBRFV',
    'spodoptera',
    'frugiperda',
    'oak',
    'wilt',
    'Bretziella',
    'Agrilus',
    'planipennis',
    'Thaumatotibia',
    'leucotreta',
    'Xylotrechus',
    'chinensis',
    'Toumeyella',
    'parvicornis',
    'Ceratocystis',
    'platani',
    'chancre',
    'platane',
]

# Error-message rules (56 entries; two are glued by a missing comma).
ERROR_RULES = [
    '^JavaScript is not available\\.$',
    '^Error$',
    '^Text$',
    '^NA$',
    '^Timeout error$',
    '^post_title$',
    '^\\d+$',
    '^.*cookie.*$',
    '^.*JavaScript.*$',
    '^.*your browser.*$',
    '^Please turn JavaScript on and reload the page$',
    '^None$',
    '^Loading(\\.)*$',
    '^Not Found$',
    '^Access Restricted$',
    '^Page Not Found$',
    '^\\[\\]$',
    '^blacklisted',
    "^'NoneType' object has no attribute 'get'?$",
    '^Copyright All Rights Reserved.+$^PPlease Wait\\.\\.\\.\\s+\\| Cloudflare$',
    '^HTTPSConnectionPool.*',
    '^HTTPConnectionPool.*',
    '^Checking your browser.*',
    '^Please update your browser$',
    "^JavaScript n'est pas disponible\\.$",
    '^Vos données\\. Votre expérience\\.*$',
    '^Before you continue to YouTube$',
    '^Google Search Console$',
    '^Just a moment(\\.)*',
    '^Your data\\. Your experience\\.$',
    '^Access Denied$',
    '^Need Help \\?$',
    '^Please Wait\\.\\.\\. \\| Cloudflare$',
    '^Download PDF$',
    '^\\(нет голосов\\) Loading\\.\\.\\.$',
    '^Article not found$',
    '^Vos informations, votre expérience$',
    'JavaScript 5',
    '^Pardon Our Interruption$',
    '^æ£å¨åå¾ï¼è¯·ç¨å...$',
    '^index$',
    '^JavaScript',
    '^We apologize for the inconvenience\\.\\.\\.$',
    '^Preparing your download$',
    '^: 21 \\(7\\)$',
    '^I tuoi dati, la tua esperienza$',
    '^Verificaţi adresa de email$',
    '^I tuoi dati. La tua esperienza.$',
    '^Modification de page en cours$',
    '^404$',
    '^2022å¹´ä¸åå¹´æµ·å ³æªè·æ£ç«æ§æå®³çç©3.1ä¸ç§æ¬¡$',
    '^Untitled$',
    '^Sorry!$',
    '^Thanks you$',
    '^#25$',
    '^æå¦ç§ç$',
]

# Header / menu rules (190 entries).
HEADER_RULES = [
    '^Home$',
    '^Facebook$',
    '^Idioma$',
    '^Publications$',
    '^Buscar$',
    '^Search$',
    '^Archives$',
    '^Author Details$',
    '^Facebook\\s+Twitter\\s+Instagram$',
    '^Sequence Features$',
    '^Discover open access scientific publications$',
    '^Abbonati subito$',
    '^News$',
    '^Related Articles$',
    '^常用链接$',
    '^Cultures$',
    '^Browse Articles$',
    '^Article Versions Notes$',
    '^Datasets$',
    '^Search Results$',
    '^Browsing by Title$',
    '^Search\\. Read\\. Cite\\.$',
    '^Agricultura$',
    '^datosrevista$',
    '^Journal$',
    '^Table of Contents$',
    '^Text Availability$',
    '^Recherche$',
    '^Agriculture$',
    '^Noticias$',
    '^Current Science$',
    '^Sighting detail$',
    '^Cloudflare$',
    '^Mi cuenta\\s+Cerrar Sesión$',
    '^Ganadería Sostenible$',
    '^Vidéos$',
    '^.*pdf$',
    '^Attualità$',
    '^Actualités$',
    '^Latest$',
    '^Video$',
    '^Ambiente$',
    '^Свързани продукти$',
    '^Find Search Results$',
    '^Podobné produkty$',
    '^Articles$',
    '^Notizie$',
    '^Expert Groups$',
    '^Categories$',
    '^NOTÍCIAS$',
    '^News Flash$',
    '^Résultats de la recherche$',
    '^References$',
    '^Index$',
    '^Search results$',
    '^Advance articles$',
    '^Pesquisa$',
    '^Notícias$',
    '^Browsing by Subject$',
    '^Information$',
    '^Home 1$',
    '^Programs and Projects$',
    '^Institucional$',
    '^Collections$',
    '^Tags$',
    '^最新消息$',
    '^Author Search Results$',
    '^检索结果$',
    '^Connexion$',
    '^Derniers Articles$',
    '^Notizie - Attualità$',
    '^Notizie dal Comune$',
    '^Data Reports$',
    '^Single Sign-Off$',
    '^TRIPS & CLUBS$',
    '^文献搜索$',
    '^Publication Info.$',
    '^文章基本信息$',
    '^Fiestas$',
    '^ART$',
    '^Referencias$',
    '^Journal$',
    '^Sfoglia per Autore$',
    '^Economía$',
    '^Blogs?$',
    '^b|Browse$',
    '^Perfil do autor$',
    '^Accueil$',
    '^TikTok$',
    '^MSN$',
    '^Animaux$',
    '^Société$',
    '^Shop$',
    '^Destaques$',
    '^Teses de Doutorado$',
    '^Srodni proizvodi$',
    '^Agricoltura$',
    "^Avant d'accéder à Google$",
    '^Subscription$',
    '^Detalles de autor/a$',
    '^Inicio$',
    '^general profile$',
    '^Make a Submission$',
    '^Savjetuje$',
    '^Select your language$',
    '^Susiję produktai$',
    '^Príbuzné produkty$',
    '^Author: admin$',
    '^Todas as Notícias$',
    '^S|shop$',
    '^Archive$',
    '^Your search returned . results\\.$',
    '^Category: Uncategorized$',
    '^検索結果$',
    '^Сўнгги янгиликлар$',
    '^Research articles$',
    '^Catalogo$',
    '^Main navigation$',
    '^Articles in 20..$',
    '^Listar$',
    '^个人用户登录$',
    '^相关产品$',
    '^Newsroom$',
    '^Narrow Search$',
    '^Limites de sujet actuelles :$',
    '^Activities: Projects$',
    '^acesso aberto$',
    '^Цени на тържища и борси$',
    '^Welcome$',
    '^Link Diretti$',
    '^Búsqueda$',
    '^Login • Instagram$',
    '^Bloomberg$',
    '^Calculating Ephemerides$',
    '^Categoría$',
    '^Search Papers$',
    '^Economia$',
    '^Notizie e Avvisi$',
    '^Products$',
    '^Main Menu$',
    '^Main menu$',
    '^Produtos Relacionados$',
    '^All News$',
    '^Artigo$',
    '^Browsing Tesis by Title$',
    '^Sobre la biblioteca$',
    '^Thanks you$',
    '^détails \\| FAO$',
    '^Presse$',
    '^Search speeches$',
    '^Banco de Notícias$',
    '^Novedades$',
    '^Homepage$',
    '^Glosario$',
    '^Program$',
    '^Events$',
    '^Contact Us$',
    '^Politica$',
    '^Discover$',
    '^Publication$',
    '^Search all articles$',
    '^Documentos$',
    '^seguici su$',
    '^indexadores$',
    '^Details$',
    '^Información$',
    '^Publications and data$',
    '^Titulares$',
    '^GET TO KNOW US$',
    '^vos critères$',
    '^Dictionnaire$',
    '^Contacto$',
    '^¡Suscríbete!$',
    '^Lines of research$',
    '^Metabuscador$',
    '^Portale dei servizi$',
    '^Nieuws$',
    '^Repositorio Digital$',
    '^Pubblicazioni$',
    '^Comunicati$',
    "^Toute l'actualité$",
    "^Aide à l'outil informatique$",
    '^vikaspedia Domains$',
    '^Job Posting$',
    '^Shop$',
    '^Shop$',
    '^Shop$',
    '^Shop$',
    '^Shop$',
    '^Shop$',
]

# Extra rules for titles (29 entries). Abstract and full text use these as well.
TITLE_EXTRA_RULES = [
    '^About$',
    '^browser compatibility check',
    '^Please turn JavaScript on and reload the page\\.',
    '^ORCID$',
    '^SeedQuest$',
    '^X-MOL$',
    '^Careers at UF$',
    '^Browsing NTU Scholars$',
    '^Moteur de recherche VSI$',
    '^Арзон уй-жойлар ажратиш бўйича рўйхатга олинган фуқаролар рўйхати$',
    '^Species belonging to selected taxon:$',
    '^Card ar$',
    '^Cb Phone Number$',
    '^康朗生物官方商城$',
    '^Sf9 畫皮$',
    '^University, Subject, Country, Region, World$',
    '^Save BIG with \\$9.99 \\.COMs from GoDaddy!$',
    '^Deze website maakt gebruik van cookies$',
    '^Media Statements$',
    '^Order Article Reprints$',
    '^Bienvenue à Jonquerettes$',
    '^Assistant inspecteur \\(H/F\\)$',
    '^Faw IPM APK Download for Android$',
    '^Capacitación$',
    '^Acuerdos Ministeriales$',
    '^Event$',
    '^Feedback$',
    '^Journal$',
    '^Journal$',
]

# Extra rules written for abstracts (16 entries); inactive in the compat rule set.
ABSTRACT_EXTRA_RULES = [
    '^Access denied',
    '^JavaScript is not available\\.',
    '^NA$',
    '^post_title',
    '^Please enable JavaScript',
    '^Request Access',
    '^We have detected invalid data in your input',
    '^Sorry, for some reason',
    '^Request unsuccessful',
    '^All articles published by MDPI are made immediately available',
    '^uses cookies',
    '^utiliza Cookies',
    '^Matéria não encontrada',
    '^Something went wrong',
    '^Wait a moment and try again',
    '^Faw IPM APK Download for Android',
]

# Extra rules written for full texts (21 entries); inactive in the compat rule set.
FULLTEXT_EXTRA_RULES = [
    '^Access denied',
    '^JavaScript is not available.',
    '^NA$',
    '^post_title',
    '^Please enable JavaScript',
    '^Request Access',
    '^We have detected invalid data in your input',
    '^Sorry, for some reason',
    '^Request unsuccessful',
    '^All articles published by MDPI are made immediately available',
    '^uses cookies',
    '^utiliza Cookies',
    '^Matéria não encontrada',
    '^Something went wrong',
    '^Wait a moment and try again',
    '^privacy gate$',
    '^\\nPrivacy\\n',
    '^Please change your browser',
    '^ANALISI\\s+Atlantide\\s+Mezzaluna',
    '^Click here to sign up',
    '^Browsing Docencia by Title$',
]

# Website / journal name rules (198 entries).
SITE_NAME_RULES = [
    '^Portal TecnoAgrÃcola$',
    '^Portal Embrapa$',
    '^puglialive.net$',
    '^SINTA$',
    '^SciELO Argentina - www\\.scielo\\.org\\.ar$',
    '^Argentina\\.gob\\.ar$',
    '^中国教育图书进出口有限公司$',
    '^中国图书进出口\\(集团\\)总公司$',
    '^农科机构知识库联盟$',
    '^首页仓储检索$',
    '^Pakistan Journal of Zoology$',
    '^Sighting detail - www\\.ornitho\\.it$',
    '^PubAg$',
    '^Agroscope$',
    '^Journal of Plant Protection Research$',
    '^Krushikendra\\.com$',
    '^Loading · OA.mg$',
    '^Regione \\| Canale 58 - la TV del territorio$',
    '^AD$',
    '^CIMMYT Publications Repository$',
    '^EPPO Global Database$',
    '^Create a SciFeed alert for new publications$',
    '^Bibliothèque numérique DUDDAL.+$',
    '^MediSys$',
    '^SciELO Paraguay - scielo\\.iics\\.una\\.py$',
    '^Universidad Mayor de San Andrés$',
    '^FAO\\.org$',
    '^Bibliothéque FST de Fès$',
    '^PMI-Reboot$',
    '^nordbayern\\.de$',
    '^Instituto Valenciano de Investigaciones Agrarias \\(IVIA\\) .*$',
    "^Institut Valencià d'Investigacions Agràries \\(IVIA\\) - IVIA - Generalitat Valenciana$",
    '^Generalitat Valenciana$',
    '^Buonasera \\| News$',
    '^Eingeschleppter Schädling...Japankäfer erreicht Baden-Württemberg$',
    '^CORC$',
    '^16 e  législature$',
    '^Portal da Agencia o Globo$',
    '^DSpace Angular ::Estadísticas$',
    '^Vidéos | Corse Net Infos$',
    '^UniProt website fallback message$',
    '^中国热带农业科学院机构知识库$',
    '© Mairie de Maussane',
    '^Browsing MT$',
    'Menu\\s+Home\\s+Expert\\s+search\\s+Contact\\s+About\\s+AGUIA',
    '^Digital Newspaper & Magazine Subscriptions$',
    '^Consultas fitossanitárias e Receituário Agronômico$',
    '^$',
    '^@tube$',
    '^检索结果-维普期刊 中文期刊服务平台$',
    '^WebPathology$',
    '^RISS 검색$',
    '^DPG Media Privacy Gate$',
    '^國家教育研究院雙語詞彙、學術名詞暨辭書資訊網$',
    '^gobertpartners\\.com$',
    '^International Institute of Tropical Agriculture \\(IITA\\)$',
    '^瀏覽 NTU Scholars$',
    'Provincia di Asti',
    '^Asaja Asociación Agraria de Jóvenes Agricultores$',
    '^View Gos Unik$',
    '^The Plant Pathology Journal$',
    '^Universitas Jenderal Soedirman \\(UNSOED\\) Purwokerto \\[svr1\\]$',
    '^Profil Dosen$',
    "^Les services de l'État dans le Gard$",
    '^Sun Sentinel$',
    '^百度学术$',
    '^Comune di Gerenzano Provincia di Varese$',
    '^ACIAR Australia$',
    '^AgriSolución$',
    '^Università del Salento$',
    '^Browsing UT$',
    '^Hoвости | Turkmen.News$',
    '^North American Plant Protection Organization$',
    '^Universitas Jenderal Soedirman \\(UNSOED\\) Purwokerto \\[svr3\\]$',
    '^Invasive Species Compendium (ISC) | CABI$',
    '^重组蛋白$',
    '^最新消息$',
    '^Canale 7$',
    '^Publication Search \\| US Forest Service Research and Development$',
    '^idw – Informationsdienst Wissenschaft$',
    '^ScienceDirect Topics in Agricultural and Biological Sciences$',
    '^Agro Excelencia$',
    '^Frontiers in Physiology \\| Articles$',
    '^Home - Akse Media$',
    '^Управление Федеральной службы по ветеринарному и фитосанитарному надзору по Тюменской области,Ямало-Ненецкому и Ханты-Мансийскому автономным округам$',
    '^农业机构知识库联盟$',
    '^SICRIS$',
    '^Monde scientifique$',
    '^Optica Publishing Group$',
    '^Comune di Castellana Grotte$',
    '^guce$',
    '^Artificial Intelligence in Cancer$',
    '^The Healthy Journal - Gluten, Dairy, Sugar Free Recipes, Interviews and Health Articles$',
    '^ScienceDirect\\.com \\| Science, health and medical journals, full text articles and books\\.',
    '^Biological Forum-An International Journal$',
    '^Le Journal Catalan$',
    '^agroorganico$',
    '^Pakistan Journal of Agricultural Research$',
    '^aTkati 농수산식품수출지원정보$',
    '^Zinfos974$',
    '^Sf9 畫皮$',
    '^Cronaca$',
    '^• Provincia di Asti$',
    '^MINISTERO DELLE POLITICHE AGRICOLE ALIMENTARI E FORESTALI$',
    '^The Gabber$',
    '^Sigpro$',
    '^Comune di Omegna$',
    '^Mazii - Rated #1 Japanese English Dictionary Online$',
    '^Maryland Biodiversity - County Records$',
    '^SIGAA$',
    '^Region Vrbas$',
    '^Arboricultural Association$',
    '^CIHEAM Bari$',
    '^Frontiers in Insect Science \\| Invasive Insect Species$',
    '^GOVPH$',
    '^Informatics Publishing Limited$',
    '^농기자재신문\\(주\\)$',
    '^Direktorat Perlindungan Tanaman Pangan$',
    '^文章搜索——西北农林期刊网$',
    '^Lic\\. Alejandra Daguerre$',
    '^Browsing Escuela de Ingeniería Agropecuaria by Title$',
    '^Markets and Trade – Food and Agriculture Organization of the United Nations$',
    '^Browse \\| ASHS$',
    '^zmianynaziemi\\.pl$',
    '^Revista Torreón Universitario$',
    '^Actualités de la VSI$',
    '^UC Statewide IPM Program \\(UC IPM\\)$',
    '^Document card \\| FAO$',
    '^Frontiers in Insect Science$',
    '^AMiner$',
    '^Frontiers in Plant Science \\| Articles$',
    '^Search \\| GOV.SI$',
    '^doiSerbia$',
    "^Regione autonoma Valle d'Aosta$",
    '^International Plant Protection Convention$',
    '^Novice - Občina Ljutomer$',
    '^Biblioteca Digital INIA$',
    '^India Biodiversity Portal$',
    '^Podoslonami.pl$',
    '^Universidad Politécnica de Madrid$',
    '^Green Blog$',
    '^RPubs$',
    '^BioProject$',
    '^InterPro$',
    '^Animal Diversity Web$',
    '^Observatorio de I\\+D\\+i UPM$',
    '^Monochamus spp.$',
    '^INIAV, IP$',
    '^Comune di Verbania$',
    "^Le blog d'Albert Amgar$",
    '^huanglongbing$',
    '^AgrocienciaÂ vol.46Â nÃºmero4; S1405-31952012000400007$',
    '^Ossola 24$',
    '^ARIF PUGLIA$',
    '^Comté de Provence$',
    '^Flashnews.gr$',
    '^Dra. Myriam Elías Santos$',
    '^Comune di Valmacca$',
    "^Prodotti per l'Agricoltura$",
    '^CCSE$',
    '^Disciplinare.it$',
    '^UDSspace$',
    '^Camera dei deputati$',
    '^- FruitJournal$',
    '^InfoAgronomo$',
    '^UnB Pesquisa$',
    '^Gente en Valencia$',
    '^Noticias Jurídicas$',
    '^Invaio X Gli Ulivi$',
    '^Products | Syngenta$',
    '^Association Bernard Gregory$',
    '^agronoticias.es$',
    '^AgroNotizie - Notizie agricoltura$',
    '^Regione Lazio$',
    '^University of Zimbabwe Libraries$',
    '^Alice: Search$',
    '^AgroAvances$',
    '^Jurnal Cyber Tech$',
    '^La Rioja | Rioja2.com$',
    '^BIBLIOS$',
    '^UMR PVBMT$',
    '^Epernay$',
    '^#tobrfv - Explore$',
    '^Publication card | FAO$',
    '^InforCNA$',
    '^Ansamed$',
    '^nutrixrevolution$',
    '^Osservatorio Agromafie$',
    '^Citricos.com$',
    '^MycoKeys$',
    '^Alerta Diário$',
    '^Avvisi$',
    '^ProfessorJohnMumford$',
    '^RCI Guadeloupe$',
    '^Les actualités communales$',
    '^BJA Ferramenta de Leitura$',
    '^fhalmería$',
    '^fhalmería$',
]
