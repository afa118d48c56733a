import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tablecraft.session import build_session

    session = build_session("local[8]", 8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def employees(spark):
    rows = [("Rahul", "23", "$50,000", "hr"), ("Amit", "NULL", "$55,000", "HR"), ("Priya", "25", "", "Human Resources"),
            ("Rahul", "23", "$50,000", "hr")]
    return spark.createDataFrame(rows, "Name string, Age string, Salary string, Department string")


@pytest.fixture(scope="session")
def landed(spark, employees):
    """Employees as a page scan delivers them: null tokens already null."""
    from tablecraft.plans.recipe import apply_step

    return apply_step(employees, {"action": "null_tokens"})


@pytest.fixture(scope="session")
def churn(spark):
    income = [45, 52, 38, 68, 85, 92, 29, 61, 34, 74]
    spending = [39, 81, 15, 77, 40, 76, 12, 55, 22, 68]
    tenure = [12, 24, 6, 36, 18, 48, 4, 20, 8, 30]
    actions = [14, 32, 8, 45, 22, 56, 5, 28, 9, 41]
    regions = list("NNSEWWSENS")
    rows = [
        (f"C{101 + i}", f"${income[i]},000", spending[i], tenure[i], actions[i], "Yes" if i in (2, 6, 8) else "No", regions[i])
        for i in range(10)
    ]
    return spark.createDataFrame(
        rows, "CustomerID string, Annual_Income string, Spending_Score int, Tenure_Months int, Transactions int, Churned string, Region string")


def rows_of(df, *columns):
    return sorted(map(tuple, (df.select(*columns) if columns else df).collect()), key=str)
