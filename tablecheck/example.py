"""A small pair of files with seven planted differences, to try a comparison on.

A row missing from the target, a row that only the target has, a value padded with blanks, one in other case, an empty text
for a NULL, a price a cent off, and a country that really changed; the target also has a column of its own.
"""

from __future__ import annotations

SOURCE = """customer_id,name,email,country,lifetime_value,signup_date
501,Ines Aalto,ines@example.com,FI,310.00,2021-02-11
502,Jonas Brandt,jonas@example.com,DE,1270.25,2020-07-30
503,Keiko Chiba,keiko@example.com,JP,88.40,2022-01-05
504,Lars Dahl,,NO,0.00,2023-03-19
505,Mina Erdem,mina@example.com,TR,945.10,2019-11-02
506,Noor Faruk,noor@example.com,BD,77.77,2022-08-08
507,Olga Gorska,olga@example.com,PL,560.00,2021-12-24
508,Pedro Horta,pedro@example.com,PT,42.15,2023-06-01
509,Qi Ito,qi@example.com,JP,1999.99,2018-05-16
510,Rosa Jimenez,rosa@example.com,ES,12.00,2023-10-10
511,Sami Koski,sami@example.com,FI,305.50,2020-01-31
512,Tara Lund,tara@example.com,SE,640.80,2022-04-22
"""
TARGET = """customer_id,name,email,country,lifetime_value,signup_date,loaded_at
501,Ines Aalto,ines@example.com,FI,310.00,2021-02-11,2024-05-01
502,Jonas Brandt ,jonas@example.com,DE,1270.25,2020-07-30,2024-05-01
503,Keiko Chiba,keiko@example.com,JP,88.40,2022-01-05,2024-05-01
504,Lars Dahl,"",NO,0.00,2023-03-19,2024-05-01
505,Mina Erdem,MINA@example.com,TR,945.10,2019-11-02,2024-05-01
506,Noor Faruk,noor@example.com,BD,77.77,2022-08-08,2024-05-01
507,Olga Gorska,olga@example.com,PL,560.01,2021-12-24,2024-05-01
508,Pedro Horta,pedro@example.com,BR,42.15,2023-06-01,2024-05-01
509,Qi Ito,qi@example.com,JP,1999.99,2018-05-16,2024-05-01
510,Rosa Jimenez,rosa@example.com,ES,12.00,2023-10-10,2024-05-01
511,Sami Koski,sami@example.com,FI,305.50,2020-01-31,2024-05-01
613,Uma Moreau,uma@example.com,FR,5.00,2024-02-29,2024-05-01
"""
FILES = {"customers_source.csv": SOURCE, "customers_target.csv": TARGET}
