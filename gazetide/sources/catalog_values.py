"""Default publisher catalog."""

# Publishers in their canonical order, with the addresses of their news, whether
# all routes are read and put together, and their named routes by priority.
PUBLISHERS = [
    {"name": "行政院", "urls": [
        "https://www.ey.gov.tw/Page/6485009ABEC1CB9C?PS=50&page=1",
        "https://www.ey.gov.tw/RSS_Content.aspx?ModuleType=3",
    ], "aggregate_routes": False, "routes": [
        {"id": "official-html", "url": "https://www.ey.gov.tw/Page/6485009ABEC1CB9C?PS=50&page=1", "kind": "html",
         "parser": "ey-html", "priority": 1, "coverage_reduced": False},
        {"id": "official-rss", "url": "https://www.ey.gov.tw/RSS_Content.aspx?ModuleType=3", "kind": "rss",
         "parser": "standard-rss", "priority": 2, "coverage_reduced": False},
    ]},
    {"name": "監察院", "urls": ["https://www.cy.gov.tw/OpenData.aspx?SN=ADE5198E06414AF5"], "aggregate_routes": False, "routes": []},
    {"name": "司法院", "urls": [
        "https://www.judicial.gov.tw/tw/lp-1790-1-1-40.html",
        "https://www.judicial.gov.tw/tw/lp-1790-1-2-40.html",
        "https://www.judicial.gov.tw/tw/lp-1790-1-3-40.html",
        "https://www.judicial.gov.tw/tw/lp-1790-1-4-40.html",
        "https://www.judicial.gov.tw/tw/lp-1790-1-5-40.html",
    ], "aggregate_routes": True, "routes": []},
    {"name": "內政部", "urls": ["https://www.moi.gov.tw/news.aspx?n=4&sms=9009"], "aggregate_routes": False, "routes": []},
    {"name": "國土管理署", "urls": ["https://www.nlma.gov.tw/sites/www.nlma.gov.tw/ch/main/news/list.json"], "aggregate_routes": False, "routes": [
        {"id": "official-json", "url": "https://www.nlma.gov.tw/sites/www.nlma.gov.tw/ch/main/news/list.json", "kind": "json",
         "parser": "nlma-json", "priority": 1, "coverage_reduced": False},
    ]},
    {"name": "國家公園署", "urls": ["https://www.nps.gov.tw/sites/www.nps.gov.tw/ch/main/parknews/list.json"], "aggregate_routes": False, "routes": [
        {"id": "official-json", "url": "https://www.nps.gov.tw/sites/www.nps.gov.tw/ch/main/parknews/list.json", "kind": "json",
         "parser": "nps-json", "priority": 1, "coverage_reduced": False},
    ]},
    {"name": "國土測繪中心", "urls": ["https://www.nlsc.gov.tw/OpenData.aspx?SN=6880137375636088"], "aggregate_routes": False, "routes": []},
    {"name": "警政署", "urls": ["https://www.npa.gov.tw/ch/app/news/list?module=news&id=2139"], "aggregate_routes": False, "routes": []},
    {"name": "消防署", "urls": ["https://www.nfa.gov.tw/pro/index.php?code=list&ids=1470"], "aggregate_routes": False, "routes": []},
    {"name": "外交部", "urls": ["https://www.mofa.gov.tw/News.aspx?n=95&sms=73"], "aggregate_routes": False, "routes": []},
    {"name": "僑委會", "urls": ["https://www.ocac.gov.tw/OCAC/Pages/List.aspx?nodeid=3018"], "aggregate_routes": False, "routes": []},
    {"name": "陸委會", "urls": ["https://www.mac.gov.tw/OpenData.aspx?SN=D33B55D537402BAA"], "aggregate_routes": False, "routes": []},
    {"name": "國防部", "urls": ["https://www.mnd.gov.tw/news/pressreleaselist"], "aggregate_routes": False, "routes": []},
    {"name": "中科院", "urls": ["https://www.ncsist.org.tw/csistdup/news/NewsPublish.aspx"], "aggregate_routes": False, "routes": []},
    {"name": "國防院", "urls": ["https://indsr.org.tw/informationlist?uid=7"], "aggregate_routes": False, "routes": []},
    {"name": "財政部", "urls": [
        "https://www.mof.gov.tw/Rss/384fb3077bb349ea973e7fc6f13b6974",
        "https://www.etax.nat.gov.tw/etwmain/rss/news",
    ], "aggregate_routes": True, "routes": []},
    {"name": "金管會", "urls": ["https://www.fsc.gov.tw/RSS/Messages?serno=201202290009&language=chinese"], "aggregate_routes": False, "routes": []},
    {"name": "公平會", "urls": ["https://www.ftc.gov.tw/internet/main/rss/rss_1.xml"], "aggregate_routes": False, "routes": []},
    {"name": "中央銀行", "urls": ["https://www.cbc.gov.tw/tw/lp-302-1.html"], "aggregate_routes": False, "routes": []},
    {"name": "主計總處", "urls": ["https://www.dgbas.gov.tw/OpenData.aspx?SN=0DA0FD2F5416554E"], "aggregate_routes": False, "routes": []},
    {"name": "人事總處", "urls": ["https://www.dgpa.gov.tw/rsscon?uid=82"], "aggregate_routes": False, "routes": []},
    {"name": "教育部", "urls": ["https://www.edu.tw/News.aspx?n=9E7AC85F1954DDA8&sms=169B8E91BB75571F"], "aggregate_routes": False, "routes": []},
    {"name": "國教院", "urls": ["https://www.naer.edu.tw/PageDoc?fid=15"], "aggregate_routes": False, "routes": []},
    {"name": "運動部", "urls": ["https://www.sports.gov.tw/News/309"], "aggregate_routes": False, "routes": [
        {"id": "official-browser", "url": "https://www.sports.gov.tw/News/309", "kind": "browser",
         "parser": "sports-html", "priority": 1, "coverage_reduced": False},
    ]},
    {"name": "法務部", "urls": ["https://www.moj.gov.tw/2204/2795/2796/rss"], "aggregate_routes": False, "routes": []},
    {"name": "矯正署", "urls": ["https://www.mjac.moj.gov.tw/4786/4963/4965/"], "aggregate_routes": False, "routes": [
        {"id": "primary-html", "url": "https://www.mjac.moj.gov.tw/4786/4963/4965/", "kind": "html",
         "parser": "mjac-html", "priority": 1, "coverage_reduced": False},
        {"id": "official-latest-news", "url": "https://www.mjac.moj.gov.tw/4786/654264/", "kind": "html",
         "parser": "mjac-html", "priority": 2, "coverage_reduced": True},
    ]},
    {"name": "最高檢察署", "urls": ["https://www.tps.moj.gov.tw/16314/1140948/"], "aggregate_routes": False, "routes": []},
    {"name": "經濟部", "urls": ["https://www.moea.gov.tw/Mns/Populace/news/News.aspx?kind=1&menu_id=40"], "aggregate_routes": False, "routes": [
        {"id": "official-browser", "url": "https://www.moea.gov.tw/Mns/Populace/news/News.aspx?kind=1&menu_id=40", "kind": "browser",
         "parser": "moea-html", "priority": 1, "coverage_reduced": False},
    ]},
    {"name": "交通部", "urls": ["https://www.motc.gov.tw/ch/app/news_list/query?module=news&id=14"], "aggregate_routes": False, "routes": []},
    {"name": "觀光署", "urls": ["https://www.taiwan.net.tw/m1.aspx?sNo=0001001"], "aggregate_routes": False, "routes": []},
    {"name": "公路局", "urls": ["https://www.thb.gov.tw/News.aspx?n=12181&sms=14672"], "aggregate_routes": False, "routes": [
        {"id": "official-browser", "url": "https://www.thb.gov.tw/News.aspx?n=12181&sms=14672", "kind": "browser",
         "parser": "thb-html", "priority": 1, "coverage_reduced": False},
    ]},
    {"name": "高速公路局", "urls": ["https://www.freeway.gov.tw/Rss/freewayrss2.xml"], "aggregate_routes": False, "routes": []},
    {"name": "航港局", "urls": ["https://www.motcmpb.gov.tw/Information/RSS?SiteId=1&NodeId=15"], "aggregate_routes": False, "routes": []},
    {"name": "中央氣象署", "urls": ["https://www.cwa.gov.tw/V8/C/S/news_data.html"], "aggregate_routes": False, "routes": []},
    {"name": "農業部", "urls": ["https://www.moa.gov.tw/open_data.php?format=rss&func=news_agri"], "aggregate_routes": False, "routes": []},
    {"name": "農業金融署", "urls": ["https://www.afna.gov.tw/list.php?theme=news&subtheme=news"], "aggregate_routes": False, "routes": [
        {"id": "primary-html", "url": "https://www.afna.gov.tw/list.php?theme=news&subtheme=news", "kind": "html",
         "parser": "afna-html", "priority": 1, "coverage_reduced": False},
        {"id": "official-rss", "url": "https://www.afna.gov.tw/wm_DATA.php?data=news", "kind": "rss",
         "parser": "standard-rss", "priority": 2, "coverage_reduced": False},
    ]},
    {"name": "農糧署", "urls": ["https://www.afa.gov.tw/cht/index.php?act=rss&ids=309"], "aggregate_routes": False, "routes": []},
    {"name": "漁業署", "urls": ["https://www.fa.gov.tw/list.php?theme=Press_release"], "aggregate_routes": False, "routes": [
        {"id": "primary-html", "url": "https://www.fa.gov.tw/list.php?theme=Press_release", "kind": "html",
         "parser": "fa-html", "priority": 1, "coverage_reduced": False},
        {"id": "official-rss", "url": "https://www.fa.gov.tw/wm_DATA.php?data=news", "kind": "rss",
         "parser": "standard-rss", "priority": 2, "coverage_reduced": False},
    ]},
    {"name": "農村發展及水土保持署", "urls": ["https://www.ardswc.gov.tw/Home/Content/RSS/press.xml"], "aggregate_routes": False, "routes": []},
    {"name": "防檢署", "urls": ["https://www.aphia.gov.tw/theme_list.php?theme=NewInfoListWS"], "aggregate_routes": False, "routes": []},
    {"name": "農科園區", "urls": ["https://www.atp.gov.tw/CHT/Rss.aspx"], "aggregate_routes": False, "routes": []},
    {"name": "衛生福利部", "urls": ["https://www.mohw.gov.tw/lp-16-1.html"], "aggregate_routes": False, "routes": []},
    {"name": "食藥署", "urls": ["https://www.fda.gov.tw/tc/rssNews.ashx"], "aggregate_routes": False, "routes": []},
    {"name": "疾管署", "urls": ["https://www.cdc.gov.tw/Bulletin/List/MmgtpeidAR5Ooai4-fgHzQ"], "aggregate_routes": False, "routes": []},
    {"name": "國健署", "urls": ["https://www.hpa.gov.tw/Pages/ashx/rsspage.ashx?nodeid=124"], "aggregate_routes": False, "routes": []},
    {"name": "社家署", "urls": ["https://www.sfaa.gov.tw/sfaa/list/5cX"], "aggregate_routes": False, "routes": [
        {"id": "primary-html", "url": "https://www.sfaa.gov.tw/sfaa/list/5cX", "kind": "html",
         "parser": "sfaa-html", "priority": 1, "coverage_reduced": False},
        {"id": "mohw-source-mirror", "url": "https://www.mohw.gov.tw/lp-16-1-40.html", "kind": "html",
         "parser": "mohw-source-filter", "priority": 2, "coverage_reduced": True},
    ]},
    {"name": "勞動部", "urls": ["https://www.mol.gov.tw/1607/1632/1633/"], "aggregate_routes": False, "routes": []},
    {"name": "勞動力發展署", "urls": ["https://www.wda.gov.tw/OpenData.aspx?SN=8C4FEB29449A1601"], "aggregate_routes": False, "routes": []},
    {"name": "職業安全衛生署", "urls": ["https://www.osha.gov.tw/48110/48417/48419/RssList"], "aggregate_routes": False, "routes": []},
    {"name": "勞動基金運用局", "urls": ["https://www.blf.gov.tw/49200/49245/49247/"], "aggregate_routes": False, "routes": []},
    {"name": "文化部", "urls": ["https://www.moc.gov.tw/OpenData.aspx?SN=C4E4E3A8E687AD91"], "aggregate_routes": False, "routes": [
        {"id": "primary-html", "url": "https://www.moc.gov.tw/OpenData.aspx?SN=C4E4E3A8E687AD91", "kind": "html",
         "parser": "standard", "priority": 1, "coverage_reduced": False},
        {"id": "official-browser", "url": "https://www.moc.gov.tw/OpenData.aspx?SN=C4E4E3A8E687AD91", "kind": "browser",
         "parser": "standard", "priority": 2, "coverage_reduced": False},
    ]},
    {"name": "故宮", "urls": ["https://www.npm.gov.tw/News-List.aspx?sno=01000001&l=1&q=&s_date=&e_date=&type=03000096"], "aggregate_routes": False, "routes": []},
    {"name": "數位發展部", "urls": ["https://moda.gov.tw/press/press-releases/372"], "aggregate_routes": False, "routes": []},
    {"name": "數位產業署", "urls": ["https://moda.gov.tw/ADI/news/latest-news/766"], "aggregate_routes": False, "routes": []},
    {"name": "資通安全署", "urls": ["https://moda.gov.tw/ACS/press/news/press/820"], "aggregate_routes": False, "routes": []},
    {"name": "國家資通安全研究院", "urls": ["https://www.nics.nat.gov.tw/latest_news/announcements/Latest_Announcement/"], "aggregate_routes": False, "routes": [
        {"id": "primary-html", "url": "https://www.nics.nat.gov.tw/latest_news/announcements/Latest_Announcement/", "kind": "html",
         "parser": "standard", "priority": 1, "coverage_reduced": False},
        {"id": "official-browser", "url": "https://www.nics.nat.gov.tw/latest_news/announcements/Latest_Announcement/", "kind": "browser",
         "parser": "standard", "priority": 2, "coverage_reduced": False},
    ]},
    {"name": "環境部", "urls": ["https://www.moenv.gov.tw/press/press-releases/2626.html?p=1&dc=50"], "aggregate_routes": False, "routes": [
        {"id": "primary-browser", "url": "https://www.moenv.gov.tw/press/press-releases/2626.html?p=1&dc=50", "kind": "browser",
         "parser": "moenv-html", "priority": 1, "coverage_reduced": False},
        {"id": "news-portal", "url": "https://enews.moenv.gov.tw/", "kind": "browser",
         "parser": "moenv-news-portal-browser", "priority": 2, "coverage_reduced": False},
    ]},
    {"name": "國發會", "urls": ["https://www.ndc.gov.tw/Rss_News.aspx?n=114AAE178CD95D4C"], "aggregate_routes": False, "routes": []},
    {"name": "國科會", "urls": ["https://www.nstc.gov.tw/folksonomy/list/9aa56881-8df0-4eb6-a5a7-32a2f72826ff?l=ch&pageSize=%EF%BC%93%EF%BC%95&pageNum=1"], "aggregate_routes": False, "routes": []},
    {"name": "國家實驗研究院", "urls": ["https://www.niar.org.tw/xmdoc?xsmsid=0I148622737263495777"], "aggregate_routes": False, "routes": []},
    {"name": "國家太空中心", "urls": ["https://www.tasa.org.tw/zh-TW/announcements/news"], "aggregate_routes": False, "routes": []},
    {"name": "原民會", "urls": ["https://www.cip.gov.tw/zh-tw/rss/35AE118732EB6BAF/news.html"], "aggregate_routes": False, "routes": []},
    {"name": "客委會", "urls": ["https://www.hakka.gov.tw/chhakka/app/data/list?id=25"], "aggregate_routes": False, "routes": []},
    {"name": "海委會", "urls": ["https://www.oac.gov.tw/News?language=chinese&websitedn=ch"], "aggregate_routes": False, "routes": []},
    {"name": "海巡署", "urls": ["https://www.cga.gov.tw/GipOpen/wSite/rss?ctNode=650&mp=999"], "aggregate_routes": False, "routes": []},
    {"name": "艦隊分署", "urls": ["https://www.cga.gov.tw/GipOpen/wSite/rss?ctNode=2116&mp=9997"], "aggregate_routes": False, "routes": []},
    {"name": "偵防分署", "urls": ["https://www.cga.gov.tw/GipOpen/wSite/rss?ctNode=10619&mp=9998"], "aggregate_routes": False, "routes": []},
    {"name": "退輔會", "urls": ["https://www.vac.gov.tw/lp-1788-1.html"], "aggregate_routes": False, "routes": []},
    {"name": "榮總", "urls": ["https://www.vghtpe.gov.tw/News.action?gcode=A05"], "aggregate_routes": False, "routes": [
        {"id": "official-browser", "url": "https://www.vghtpe.gov.tw/News.action?gcode=A05", "kind": "browser",
         "parser": "vghtpe-html", "priority": 1, "coverage_reduced": False},
    ]},
    {"name": "通傳會", "urls": ["https://api.ncc.gov.tw/chncc/rss/News?id=50"], "aggregate_routes": False, "routes": []},
    {"name": "工程會", "urls": ["https://www.pcc.gov.tw/content/News.aspx?n=C61062639C0CD29F&sms=21EF9CF82726C1BB"], "aggregate_routes": False, "routes": [
        {"id": "primary-html", "url": "https://www.pcc.gov.tw/content/News.aspx?n=C61062639C0CD29F&sms=21EF9CF82726C1BB", "kind": "html",
         "parser": "pcc-html", "priority": 1, "coverage_reduced": False},
        {"id": "official-open-data", "url": "https://www.pcc.gov.tw/content/opendata?item=news&n=CF5DF99964D9DB8E", "kind": "rss",
         "parser": "standard-rss", "priority": 2, "coverage_reduced": False},
    ]},
    {"name": "中選會", "urls": ["https://web.cec.gov.tw/central"], "aggregate_routes": False, "routes": []},
]
