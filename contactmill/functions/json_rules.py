"""Fixed values for the JSON-LD filter: which keys to keep, to drop and how to group them."""

# --- fixed values ---------------------------------------------------------------------------------------------
KEEP = [
    "headline", "name", "title", "description", "articleBody", "text", "content", "mainEntityOfPage", "url", "sameAs",
    "keywords", "articleSection", "about", "publisher", "author", "organization", "brand", "manufacturer", "provider",
    "legalName", "foundingDate", "location", "address", "contactPoint", "telephone", "email", "areaServed",
    "serviceType", "priceRange", "jobTitle", "worksFor", "affiliation", "alumniOf", "memberOf", "knowsAbout",
    "hasOccupation", "nationality", "birthPlace", "category", "model", "sku", "gtin", "price", "priceCurrency",
    "availability", "condition", "review", "rating", "offers", "startDate", "endDate", "organizer", "performer",
    "audience", "genre", "inLanguage", "copyrightHolder", "license", "isAccessibleForFree", "itemListElement",
    "numberOfItems", "itemListOrder", "parentOrganization", "subOrganization", "member", "hasPart", "isPartOf",
    "relatedTo", "mentions", "citation", "isBasedOn"]
DROP = [
    "logo", "image", "thumbnail", "thumbnailUrl", "photo", "picture", "identifier", "id", "@id", "uuid", "guid",
    "width", "height", "coordinates", "encodingFormat", "contentSize", "uploadDate", "embedUrl", "playerType",
    "requiresSubscription", "sha256", "contentUrl", "embedCode", "duration", "bitrate", "videoFrameSize",
    "videoQuality", "aspectRatio", "caption", "potentialAction", "mainEntity", "hasPart", "workExample",
    "exampleOfWork", "workTranslation", "translationOfWork", "datePublished", "dateModified", "dateCreated",
    "wordCount", "breadcrumb", "mainNavigationElement", "primaryImageOfPage", "significantLink", "relatedLink",
    "lastReviewed", "reviewedBy", "masthead", "correctionsPolicy", "ethicsPolicy", "publishingPrinciples",
    "missionCoveragePrioritiesPolicy", "ownershipFundingInfo", "verificationFactCheckingPolicy", "privacyPolicy",
    "termsOfService"]
CONTEXT = ["@context", "@type", "@graph"]
GROUPS = [("organization", ["publisher", "legalName", "foundingDate", "organization", "brand"]),
          ("person", ["author", "jobTitle", "worksFor", "affiliation"]),
          ("contact", ["telephone", "email", "address", "location", "url", "sameAs"]),
          ("business", ["serviceType", "priceRange", "areaServed", "category"]),
          ("metadata", ["datePublished", "dateModified", "wordCount", "@type"])]  # anything else: content
# --- end of fixed values --------------------------------------------------------------------------------------
