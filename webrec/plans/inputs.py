"""Views the queries run on, derived from the given tables.

Each view is one SELECT in the dialect both engines share, so a query and its
check SQL start from the same rows and the work grows with the tables. No view
does a join, so none adds a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# candidate links as a search run would return them, one per page
URLS = """
SELECT page_id, url AS page_url,
 CASE page_id % 26
  WHEN 0 THEN url
  WHEN 1 THEN 'https://www.yelp.com/biz/scrap-' || CAST(page_id AS STRING)
  WHEN 2 THEN 'https://city' || CAST(page_id % 90 AS STRING) || 'scrapmetal.com/about'
  WHEN 3 THEN 'http://www.google.com/search?q=metal' || CAST(page_id AS STRING)
  WHEN 4 THEN 'https://blog.medium.com/p/' || CAST(page_id AS STRING)
  WHEN 5 THEN 'https://www.Facebook.com/metal' || CAST(page_id AS STRING)
  WHEN 6 THEN 'https://duckduckgo.com/l/?uddg=https%3A%2F%2Fsite' || CAST(page_id AS STRING) || '.org%2Fx%20y&rut=1'
  WHEN 7 THEN 'https://www.bing.com/ck/a?p=' || CAST(page_id AS STRING) || '&u=a1aHR0cHM6Ly9leGFtcGxlLm9yZy94'
  WHEN 8 THEN 'https://steelguru.com/news/2024/' || CAST(page_id AS STRING) || '/copper-price'
  WHEN 9 THEN 'https://www.wsj.com/article/' || CAST(page_id AS STRING)
  WHEN 10 THEN 'https://shop' || CAST(page_id AS STRING) || '.com/category/metal/'
  WHEN 11 THEN 'ftp://files' || CAST(page_id AS STRING) || '.org/scrap'
  WHEN 12 THEN 'https://recycle.net/directory/yard' || CAST(page_id AS STRING)
  WHEN 13 THEN 'https://acme' || CAST(page_id % 70 AS STRING) || '.com/directory/list?page=2'
  WHEN 14 THEN 'http://192.168.0.1/x' || CAST(page_id AS STRING)
  WHEN 15 THEN 'https://news' || CAST(page_id AS STRING) || '.ru/новости/сталь'
  WHEN 16 THEN ''
  WHEN 17 THEN NULL
  WHEN 18 THEN 'https://ria.ru/20240101/story-news-' || CAST(page_id AS STRING) || '.html'
  WHEN 19 THEN 'https://r.msn.com/aclk?ld=1&url=https%3A%2F%2Fyard' || CAST(page_id AS STRING) || '.com%2Fcontact'
  WHEN 20 THEN ' https://Houston-Recycling' || CAST(page_id % 60 AS STRING) || '.com/services '
  WHEN 21 THEN 'https://mining.com/politics/' || CAST(page_id AS STRING)
  WHEN 22 THEN 'https://portal' || CAST(page_id AS STRING) || '.com/search?s=steel&cat=3'
  WHEN 23 THEN 'https://cdn' || CAST(page_id AS STRING) || '.com/images/logo.png'
  WHEN 24 THEN 'https://www.manta.com:8080/c/' || CAST(page_id % 50 AS STRING) || '/auto-salvage'
  ELSE 'https://news.google.com/rss?url=https%3A%2F%2Fmetalinfo.ru%2Farticle%2F' || CAST(page_id AS STRING)
 END AS url,
 CASE page_id % 5 WHEN 0 THEN 'rss' WHEN 1 THEN 'newsapi' WHEN 2 THEN 'general' WHEN 3 THEN 'metallurgy_focused' ELSE 'other' END AS source_type,
 CASE page_id % 4 WHEN 0 THEN 'business' WHEN 1 THEN 'tech' WHEN 2 THEN 'markets' END AS source_category,
 CASE page_id % 6 WHEN 0 THEN 'Scrap metal prices, call now' WHEN 1 THEN 'Salvage yard' WHEN 2 THEN 'Local weather' WHEN 3 THEN 'Contact us' WHEN 4 THEN 'Цены на сталь' END AS title,
 CASE page_id % 3 WHEN 0 THEN 'We buy copper and brass, phone us' WHEN 1 THEN 'A blog about recycling services inc' ELSE '' END AS description,
 CAST(page_id % 7 AS INT) AS page_no,
 CASE page_id % 9 WHEN 0 THEN 'Houston' WHEN 1 THEN 'New York' WHEN 2 THEN '' WHEN 3 THEN 'Recycling' ELSE 'Fresno' END AS city,
 CASE page_id % 4 WHEN 0 THEN 'Texas' WHEN 1 THEN 'California' WHEN 2 THEN 'Metal' END AS state
FROM {pages}
"""

# a company directory: customers seen as companies
COMPANIES = """
SELECT c_custkey AS id,
 CASE WHEN c_custkey % 29 = 0 THEN NULL
      WHEN c_custkey % 31 = 0 THEN 'Greatest Test Yard'
      WHEN c_custkey % 37 = 0 THEN 'Scrap Metal #' || CAST(c_custkey AS STRING)
      WHEN c_custkey % 41 = 0 THEN 'AB'
      ELSE (CASE c_custkey % 6 WHEN 0 THEN 'Copper' WHEN 1 THEN 'Scrap' WHEN 2 THEN 'Steel' WHEN 3 THEN 'General' WHEN 4 THEN 'Brass' ELSE 'Recycling' END)
           || ' ' || c_mktsegment || ' ' || CAST(c_custkey % 400 AS STRING) END AS name,
 CASE WHEN c_custkey % 5 = 0 THEN NULL
      WHEN c_custkey % 11 = 0 THEN 'www.yard' || CAST(c_custkey % 300 AS STRING) || '.net'
      WHEN c_custkey % 13 = 0 THEN 'https://facebook.com/yard' || CAST(c_custkey % 300 AS STRING)
      WHEN c_custkey % 17 = 0 THEN ''
      ELSE 'https://' || lower(c_mktsegment) || CAST(c_custkey % 350 AS STRING) || '.com/contact' END AS website,
 CASE WHEN c_custkey % 7 = 0 THEN NULL
      WHEN c_custkey % 23 = 0 THEN '713-555-1234'
      WHEN c_custkey % 6 = 1 THEN CAST(200 + c_custkey * 37 % 800 AS STRING) || '-' || CAST(200 + c_custkey * 53 % 800 AS STRING) || '-' || lpad(CAST(c_custkey * 7919 % 10000 AS STRING), 4, '0')
      WHEN c_custkey % 6 = 2 THEN '(' || CAST(100 + c_custkey * 37 % 900 AS STRING) || ') ' || CAST(100 + c_custkey * 53 % 900 AS STRING) || '-' || lpad(CAST(c_custkey * 7919 % 10000 AS STRING), 4, '0')
      WHEN c_custkey % 6 = 3 THEN '+1 ' || CAST(200 + c_custkey * 37 % 800 AS STRING) || ' ' || CAST(200 + c_custkey * 53 % 800 AS STRING) || ' ' || lpad(CAST(c_custkey * 7919 % 10000 AS STRING), 4, '0')
      WHEN c_custkey % 6 = 4 THEN CAST(200 + c_custkey * 37 % 800 AS STRING) || '.' || CAST(200 + c_custkey * 53 % 800 AS STRING) || '.' || lpad(CAST(c_custkey * 7919 % 10000 AS STRING), 4, '0')
      WHEN c_custkey % 6 = 5 THEN 'ext ' || CAST(c_custkey AS STRING)
      ELSE '555 ' || CAST(200 + c_custkey * 53 % 800 AS STRING) || ' ' || lpad(CAST(c_custkey * 7919 % 10000 AS STRING), 4, '0') END AS phone,
 CASE WHEN c_custkey % 4 = 0 THEN NULL
      WHEN c_custkey % 19 = 0 THEN 'broken-at-example'
      WHEN c_custkey % 9 = 0 THEN 'Info' || CAST(c_custkey % 500 AS STRING) || '@Test.com'
      ELSE 'sales' || CAST(c_custkey % 500 AS STRING) || '@yard.org' END AS email,
 CASE WHEN c_custkey % 6 = 5 THEN NULL
      WHEN c_custkey % 43 = 0 THEN '1234 Fake Street'
      ELSE CAST(100 + c_custkey * 17 % 9000 AS STRING) || ' Hempstead Rd' END AS address,
 CASE c_custkey % 9 WHEN 0 THEN 'Houston' WHEN 1 THEN 'Dallas' WHEN 2 THEN 'Chicago' WHEN 3 THEN 'New York'
   WHEN 4 THEN 'Fresno' WHEN 5 THEN 'Miami' WHEN 6 THEN 'Erie' WHEN 7 THEN 'Boise' END AS city,
 CASE c_custkey % 9 WHEN 0 THEN 'TX' WHEN 1 THEN 'TX' WHEN 2 THEN 'IL' WHEN 3 THEN 'NY'
   WHEN 4 THEN 'CA' WHEN 5 THEN 'FL' WHEN 6 THEN 'PA' WHEN 7 THEN 'ID' END AS state,
 CASE WHEN c_custkey % 8 = 0 THEN NULL WHEN c_custkey % 47 = 0 THEN '12345' WHEN c_custkey % 3 = 0 THEN lpad(CAST(c_custkey * 31 % 100000 AS STRING), 5, '0') || '-1234'
      ELSE lpad(CAST(c_custkey * 31 % 100000 AS STRING), 5, '0') END AS zip_code,
 CASE c_nationkey % 4 WHEN 0 THEN 'United States' WHEN 1 THEN 'USA' WHEN 2 THEN 'Canada' END AS country,
 CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'We buy copper and steel. Cash payment, certified scales. Established 1987, since 1990.'
   WHEN 2 THEN 'Environmental recycling center, ISO 14001 certified dealer. 25 years in business.'
   WHEN 3 THEN 'General goods and services: pickup service and demolition.' ELSE 'Licensed hauler. We speak Spanish and French. Visa accepted.' END AS description,
 CASE c_custkey % 4 WHEN 0 THEN 'monday-FRI 8:00 - 17:00' WHEN 1 THEN 'Open 24 hours' WHEN 2 THEN 'Mon to Sat 9:30 until 18:30, Sunday closed' END AS hours,
 CASE c_custkey % 6 WHEN 0 THEN split('copper;brass', ';') WHEN 1 THEN split('steel;iron;aluminum', ';') WHEN 2 THEN split('copper;steel;lead;zinc;nickel;brass', ';')
   WHEN 3 THEN split('plastic', ';') END AS materials,
 CASE c_custkey % 5 WHEN 0 THEN split('pickup service;container rental', ';') WHEN 1 THEN split('processing', ';')
   WHEN 2 THEN split('pickup service;roll-off containers;demolition;sorting;certified scales', ';') WHEN 3 THEN split('cash payment;commercial accounts', ';') END AS services,
 CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE CAST(25 + c_custkey % 500 / 100.0 AS DOUBLE) END AS latitude,
 CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE CAST(-95 - c_custkey % 700 / 100.0 AS DOUBLE) END AS longitude,
 CASE WHEN c_custkey % 6 = 2 THEN 'copper $3.50/lb' END AS pricing,
 CASE c_custkey % 4 WHEN 0 THEN 'map' WHEN 1 THEN 'directory' WHEN 2 THEN 'website' ELSE 'search' END AS source,
 CASE c_custkey % 3 WHEN 0 THEN 'tel_link' WHEN 1 THEN 'html_pattern' ELSE 'text_mining' END AS method,
 CAST(c_custkey % 5 + 1 AS INT) AS page_no,
 CAST(c_custkey % 20 AS INT) AS batch_id,
 c_acctbal AS relevance
FROM {customer}
"""

# articles: documents seen as parsed news articles
ARTICLES = """
SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, text AS content,
 'https://' || source || '.example.org/news/' || CAST(doc_id AS STRING) AS url,
 source, lang AS language,
 CASE WHEN doc_id % 4 = 0 THEN 'Author ' || CAST(doc_id % 10 AS STRING) END AS author,
 TIMESTAMP '2024-01-01 00:00:00' + CAST(doc_id % 45 AS INT) * INTERVAL '1' DAY + CAST(doc_id % 24 AS INT) * INTERVAL '1' HOUR AS published_at,
 TIMESTAMP '2024-03-01 00:00:00' + CAST(doc_id % 17 AS INT) * INTERVAL '1' DAY AS scraped_at,
 CASE WHEN doc_id % 3 <> 0 THEN substr(text, 1, 150) END AS summary,
 CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'material:scrap, type:prices' WHEN 2 THEN 'material:ferrous' WHEN 3 THEN 'region:asia, type:trade, type:prices'
   WHEN 4 THEN 'type:other' ELSE 'type:policy, material:scrap' END AS categories_list,
 CASE doc_id % 4 WHEN 0 THEN 'parser_a' WHEN 1 THEN 'parser_b' WHEN 2 THEN 'parser_a' ELSE 'parser_c' END AS parser,
 CAST(doc_id % 4 AS INT) AS parser_prio,
 doc_id % 3 <> 1 AS is_processed,
 doc_id % 7 = 0 AS is_published,
 CASE WHEN doc_id % 5 < 3 THEN 'Rewritten: ' || text END AS rewritten_content,
 CASE WHEN doc_id % 8 = 0 THEN 'Translated ' || split_part(text, chr(10), 1) END AS translated_title,
 CASE WHEN doc_id % 8 = 0 THEN 'Translated. ' || text END AS translated_content
FROM {documents}
"""

# crawl log: events seen as URL sightings
CRAWL = """
SELECT event_id, ts, event_type AS source, value,
 'https://site' || CAST(user_id AS STRING) || '.org/p/' || CAST(event_id % 200 AS STRING) AS url,
 'run-' || CAST(event_id % 3 AS STRING) AS run_id
FROM {events}
"""

# company web pages: the directory's companies, marked up
COMPANY_PAGES = """
SELECT id AS page_id, 'https://yard' || CAST(id AS STRING) || '.com/contact' AS url, name, n4,
 '<html><head><title>' || coalesce(name, '') || ' | Home of scrap</title>'
 || CASE WHEN id % 4 = 0 THEN '<meta name="description" content="Yard ' || CAST(id AS STRING) || ' buys copper &amp; brass.">' ELSE '' END
 || CASE id % 5
   WHEN 0 THEN '<script type="application/ld+json">{"@type":["LocalBusiness"],"name":"LD Yard ' || CAST(id AS STRING) || '","telephone":"713-868-' || n4
     || '","address":{"streetAddress":"1 Main St","addressLocality":"' || coalesce(city, '') || '","addressRegion":"TX","postalCode":"77008"},"openingHoursSpecification":[{"dayOfWeek":["https://schema.org/Monday","https://schema.org/Tuesday"],"opens":"08:00","closes":"17:00"},{"dayOfWeek":"Friday","opens":"09:00","closes":"12:00"},{"dayOfWeek":"Sunday"}]}</script>'
   WHEN 1 THEN '<script type="application/ld+json">{broken</script><script type="application/ld+json">[{"@type":"Article","name":"No"},{"@type":"Organization","name":"Org ' || CAST(id AS STRING)
     || '","email":"org' || CAST(id AS STRING) || '@ld.org","address":{"addressCountry":{"name":"Canada"}}}]</script>'
   WHEN 3 THEN '<script type="application/ld+json">{"@type":"Article","name":"Nope","publisher":{"contactPoint":{"telephone":"713-868-' || n4 || '"}}}</script>'
   ELSE '' END
 || '</head><body><h1>' || coalesce(name, '') || '</h1>'
 || CASE WHEN id % 5 = 2 THEN '<div itemprop="address"><span>Houston</span>, TX 77008</div><p>Opening hours</p><p>Mon-Fri 8-5</p><p>Sat 9-1</p>' ELSE '' END
 || CASE WHEN id % 3 = 0 THEN '<table><tr><th>Material</th><th>Price</th></tr><tr><td>Copper</td><td>$' || CAST(id % 9 + 1 AS STRING) || '.50/lb</td></tr><tr><td>Plastic</td><td>$1/lb</td></tr></table>'
    ELSE '<p>We pay $2 per lb for brass. Plastic is free.</p>' END
 || CASE WHEN id % 2 = 0 THEN '<p>Call <a href="tel:+1-713-' || CAST(200 + id % 700 AS STRING) || '-' || n4 || '">us</a></p>' ELSE '' END
 || CASE WHEN id % 6 = 1 THEN '<a href="mailto:Info' || CAST(id AS STRING) || '@yard.org?subject=hi">mail</a>' ELSE '' END
 || '<a href="https://facebook.com/yard' || CAST(id AS STRING) || '">fb</a><a href="https://wa.me/1' || CAST(id AS STRING) || '">wa</a><a href="/about">About</a><a href="https://bigscrap' || CAST(id AS STRING) || '.org/">visit</a>'
 || CASE WHEN id % 7 = 0 THEN '<div class="phone">713.681.' || n4 || '</div>' ELSE '' END
 || '</body></html>' AS html
FROM (SELECT id, city, split_part(name, ' ', 1) || ' Yard' AS name, lpad(CAST(1000 + id * 37 % 8999 AS STRING), 4, '0') AS n4 FROM (""" + COMPANIES + """) c) d
"""

# braces of the markup doubled, as both engines' templates want
COMPANY_PAGES = COMPANY_PAGES.replace("{", "{{").replace("}", "}}").replace("{{customer}}", "{customer}")

# company sites of eight shapes: where name, address, hours and contacts stand; the last names its contacts on other pages
BUSINESS_PAGES = """
SELECT id AS page_id, 'https://biz' || CAST(id AS STRING) || '.com/' AS url, country, n4,
 CASE id % 8
  WHEN 0 THEN '<html><head><title>Start</title></head><body><h1>Our metals</h1><div class="big company-name">Alpha Yard ' || CAST(id AS STRING) || '</div>'
   || '<p>Phone: 713-868-' || n4 || '</p><div class="address"><b>Find us:</b> ' || n4 || ' Main St, <span>Houston, TX 77008</span></div><div class="hours">Mon-Fri 8-5; Sat 9-1</div></body></html>'
  WHEN 1 THEN '<html><head><title>Beta Metals ' || CAST(id AS STRING) || '</title></head><body><div itemscope itemtype="https://schema.org/PostalAddress">Office: ' || n4 || ' Oak Avenue, Dallas, TX 75201</div>'
   || '<ul class="business-hours"><li>Monday to Friday: 8:00 AM - 5:00 PM,</li><li>Saturday 9am-12pm</li></ul><a href="tel:+1-214-868-' || n4 || '">call</a><a href="mailto:beta' || CAST(id AS STRING) || '@yard.org">m</a></body></html>'
  WHEN 2 THEN '<html><head><title>Go</title></head><body><div class="site-title">Gamma Steel ' || CAST(id AS STRING) || '</div><p><span itemprop="streetAddress">' || CAST(id AS STRING) || ' High St</span> <span itemprop="addressLocality">Leeds</span>'
   || ' <span itemprop="addressRegion">Yorkshire</span> <span itemprop="postalCode">LS1 4DY</span> <span itemprop="addressCountry">England</span></p><p itemprop="openingHours">Mon, Wed &amp; Fri 9am&ndash;12pm</p>'
   || '<p>Tel (0113) 496 ' || n4 || '</p><p>Fax +44 (0)113 497 ' || n4 || '</p></body></html>'
  WHEN 3 THEN '<html><head><title>Delta Iron ' || CAST(id AS STRING) || ' - Contact</title></head><body><h1 class="business-name">Delta Iron ' || CAST(id AS STRING) || '</h1><p>Address: ' || n4 || ' Elm Street, Erie, PA 16501</p>'
   || '<div class="operating-hours">Opening hours: Daily 7am to 7pm</div><p>(814) 868-' || n4 || '</p></body></html>'
  WHEN 4 THEN '<html><head><title>Epsilon Copper ' || CAST(id AS STRING) || '</title></head><body><p>Ring (02) 9374 ' || n4 || ' or 1300 97' || n4 || '.</p><div class="open-hours">Hours: Weekdays 8-12, 13-17; weekends closed</div></body></html>'
  WHEN 5 THEN '<html><head><script type="application/ld+json">{"@type":"Organization","name":"Zeta Brass ' || CAST(id AS STRING) || '","address":{"streetAddress":"' || n4 || ' Quay","addressLocality":"Dublin"},'
   || '"openingHoursSpecification":[{"dayOfWeek":"Monday","opens":"08:00","closes":"17:00"}]}</script></head><body><h1>No</h1><div class="address">1 Main St, Houston, TX 77008</div><div class="hours">Mon 1-2</div><p>01 677 ' || n4 || ', mobile +353 87 123 ' || n4 || '</p></body></html>'
  WHEN 6 THEN '<html><body><h1>Eta Lead ' || CAST(id AS STRING) || '</h1><div class="contact-info">Call us any day of the week</div><div><div class="location">Yard: ' || n4 || ' Pine Road, Boise, ID 83702</div></div>'
   || '<div class="hours">by appointment</div><div class="contact-hours">Mon to Sat 9:30 until 18:30, Sunday closed</div><p>eta' || CAST(id AS STRING) || '@yard.org</p></body></html>'
  ELSE '<html><body><h1>Theta Zinc ' || CAST(id AS STRING) || '</h1><a href="/news">News</a><a href="contact-us#form">Write</a><a href="https://other.org/contact">Partner</a><a href="/team/">Our contacts</a><a href="/contact-us">again</a></body></html>' END AS html
FROM (SELECT c_custkey AS id, CASE c_custkey % 8 WHEN 2 THEN 'United Kingdom' WHEN 4 THEN 'Australia' WHEN 5 THEN 'Ireland' ELSE 'USA' END AS country, lpad(CAST(1000 + c_custkey * 37 % 8999 AS STRING), 4, '0') AS n4 FROM {customer}) c
UNION ALL
SELECT -id * 10 - k AS page_id, 'https://biz' || CAST(id AS STRING) || '.com/' || CASE k WHEN 0 THEN 'contact-us' ELSE 'team/' END AS url, 'USA' AS country, n4,
 CASE WHEN k = 0 THEN '<html><body><h1>Contact</h1><p>theta' || CAST(id AS STRING) || '@yard.org</p>' || CASE WHEN id % 16 = 7 THEN '<p>303-868-' || n4 || '</p>' ELSE '' END || '</body></html>'
  ELSE '<html><body><h1>Team</h1><p>303-869-' || n4 || '</p></body></html>' END AS html
FROM (SELECT c_custkey AS id, explode(sequence(0, 1)) AS k, lpad(CAST(1000 + c_custkey * 37 % 8999 AS STRING), 4, '0') AS n4 FROM {customer} WHERE c_custkey % 8 = 7) c
"""
# the contact pages of a site are one SELECT each, as the engines multiply rows in different ways
_HOME, _OTHER = BUSINESS_PAGES.split("UNION ALL")
BUSINESS_PAGES = "UNION ALL".join([_HOME, *[_OTHER.replace("explode(sequence(0, 1)) AS k", f"{k} AS k") for k in (0, 1)]])
BUSINESS_PAGES = BUSINESS_PAGES.replace("{", "{{").replace("}", "}}").replace("{{customer}}", "{customer}")

# opening hours in ten written forms
HOURS_FORMS = """
SELECT id, h, CASE id % 10
  WHEN 0 THEN 'Mon-Fri ' || CAST(h AS STRING) || '-5; Sat 9-1'
  WHEN 1 THEN 'Monday to Friday: ' || CAST(h AS STRING) || ':00 AM - 5:30 PM, Saturday 9am-12pm'
  WHEN 2 THEN 'Mon, Wed & Fri ' || CAST(h AS STRING) || 'am–12pm'
  WHEN 3 THEN 'Mon to Sat ' || CAST(h AS STRING) || ':30 until 18:30, Sunday closed'
  WHEN 4 THEN 'Daily ' || CAST(h AS STRING) || 'am to 7pm'
  WHEN 5 THEN 'Weekdays ' || CAST(h AS STRING) || '-12, 13-17; weekends closed'
  WHEN 6 THEN 'Fri - Mon ' || CAST(h AS STRING) || '-2'
  WHEN 7 THEN 'Hours: Tues. through Thurs. 1-' || CAST(h AS STRING) || 'pm'
  WHEN 8 THEN 'Open 24 hours'
  ELSE 'Sat 22:00-0' || CAST(h AS STRING) || ':00, call first' END AS hours
FROM (SELECT c_custkey AS id, CAST(6 + c_custkey % 3 AS INT) AS h FROM {customer}) c
"""

# phone numbers as pages of eight countries write them
PHONE_TEXTS = """
SELECT id, n4, CASE id % 8
  WHEN 0 THEN 'USA' WHEN 1 THEN 'Canada' WHEN 2 THEN 'United Kingdom' WHEN 3 THEN 'Australia' WHEN 4 THEN 'New Zealand' WHEN 5 THEN 'Ireland' WHEN 6 THEN 'India' ELSE 'South Africa' END AS country,
 CASE id % 8
  WHEN 0 THEN 'Call (713) 868-' || n4 || ' or 1-713-869-' || n4 || ', from abroad +44 20 7946 ' || n4 || '. Order 99887766554433221100.'
  WHEN 1 THEN 'Tel. 416.868.' || n4 || ' since 2019-05-04'
  WHEN 2 THEN 'London (020) 7946 ' || n4 || ', +44 (0)161 496 ' || n4 || ', 0161 496 ' || n4
  WHEN 3 THEN 'Sydney 02 9374 ' || n4 || '; free 1800 97' || n4 || '; 13 Jan 2020'
  WHEN 4 THEN 'Auckland 09 363 ' || n4 || '; mobile 0064 21 363 ' || n4
  WHEN 5 THEN 'Dublin (01) 677 ' || n4 || ' / 087 123 ' || n4
  WHEN 6 THEN 'Mobile 98765 1' || n4 || ', office 022-2778 ' || n4
  ELSE 'Johannesburg 011 978 ' || n4 || ' $12345.67' END AS body
FROM (SELECT c_custkey AS id, lpad(CAST(1000 + c_custkey * 37 % 8999 AS STRING), 4, '0') AS n4 FROM {customer}) c
"""

VIEWS = {"business_pages": BUSINESS_PAGES, "hours_forms": HOURS_FORMS, "phone_texts": PHONE_TEXTS, "company_pages": COMPANY_PAGES, "urls": URLS, "companies": COMPANIES, "articles": ARTICLES, "crawl": CRAWL}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt to twice as many tasks as there are cores. A few bytes of a
    row become a page that takes milliseconds, while a file of such rows is so
    small that it would be read, and all its pages worked on, by one task."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, key)


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, spread, for the queries that make a page of each."""
    return spread(table(spark, sf_dir, "customer"), "c_custkey")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    used = [t for t in TABLES if "{" + t + "}" in sql]
    return spark.sql(sql, **{t: customers(spark, sf_dir) if t == "customer" else table(spark, sf_dir, t) for t in used})


def with_views(*names: str) -> str:
    """``WITH`` clause giving check SQL the same views."""
    parts = [f"{n} AS ({VIEWS[n].format(**{t: t for t in TABLES})})" for n in names]
    return "WITH " + ", ".join(parts) + " "
