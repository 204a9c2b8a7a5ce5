SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text,
    '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z0-9]', '[email]', 'g'),
    '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}', '[ip]', 'g'),
    '[0-9]{3}-[0-9]{3,4}-[0-9]{4}', '[phone]', 'g') AS text
FROM documents
