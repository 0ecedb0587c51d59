"""Small tables as CSV."""

ORDERS = """id,name,amount,status
1,Alice,150,paid
2,Bob,75.50,paid
3,Carol,500,paid
4,Alice,95,pending
5,Bob,310.25,paid
6,Alice,220,paid
7,Carol,40,pending
8,Bob,120,paid
"""
CUSTOMERS = """name,city,tier
Alice,Seattle,gold
Bob,Portland,silver
Carol,Denver,gold
"""
STAFF = """id,name,salary,active,boss
1,Ann,10,true,
2,Ben,12.5,false,Ann
3,Cid,,TRUE,Ann
"""


def write_tables(folder, **tables):
    for name, text in {"orders": ORDERS, "customers": CUSTOMERS, "staff": STAFF, **tables}.items():
        (folder / f"{name}.csv").write_text(text)
    return str(folder)
